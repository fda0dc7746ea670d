"""Cohesion features: a sentence against the one before it and against its document.

``sets`` are gathered with the sentence, ``keep`` packs what the next sentence is
compared with, ``with_previous`` brings the previous pack next to it by one
window, and the feature functions work on the pair ``here`` / ``before``.
The first sentence of a document has 0 everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plainread.functions import rules
from plainread.functions import wordlists as W


def later(value: Column) -> Column:
    return F.when(F.col("sent_id") > 0, value).otherwise(F.lit(0.0))


def sets() -> dict[str, Column]:
    """Distinct lower-case lemmas of a sentence, gathered from its token rows."""
    def distinct(test: Column) -> Column:
        return F.array_distinct(F.collect_list(F.when(test, F.col("base"))))

    pos = F.col("pos")
    return {"_words": distinct(F.col("is_alpha")),
            "_content": distinct(rules.one_of(pos, W.CONTENT_POS)),
            "_nouns": distinct(pos == "NOUN")}


def word_rates() -> dict[str, Column]:
    """Causal, temporal and intentional words over all tokens (aggregates)."""
    def rate(words: Sequence[str]) -> Column:
        return rules.ratio(F.count_if(rules.one_of(F.col("lower"), words)), F.count("text"))

    return {"causal_cohesion": rate(W.CAUSAL_COHESION),
            "temporal_cohesion": rate(W.TEMPORAL_COHESION),
            "intentional_cohesion": rate(W.INTENTIONAL_COHESION)}


def keep() -> Column:
    """The arrays of one sentence that the next one is compared with."""
    arguments = F.filter(
        F.zip_with("tok", "dep", lambda t, d: F.when(rules.one_of(d, W.ARGUMENT_DEP),
                                                     t["base"])),
        lambda lemma: lemma.isNotNull())
    verbs = F.filter(
        F.zip_with("tok", "aspect", lambda t, a: F.when(t["pos"] == "VERB", F.struct(
            t["lemma"].alias("lemma"), t["tense"].alias("tense"), a.alias("aspect")))),
        lambda verb: verb.isNotNull())
    return F.struct(F.col("_words").alias("words"), F.col("_content").alias("content"),
                    F.col("_nouns").alias("nouns"),
                    F.array_distinct(arguments).alias("arguments"),
                    verbs.alias("verbs"), F.col("tok.pos").alias("pos"))


def with_previous(rows: DataFrame, keys: Sequence[str] = ("doc_id",), column: str = "here"
                  ) -> DataFrame:
    """Adds ``before``: ``column`` of the sentence before."""
    order = Window.partitionBy(*keys).orderBy("sent_id")
    return rows.withColumn("before", F.lag(column).over(order))


def _shared(name: str) -> Column:
    now, before = F.col(f"here.{name}"), F.col(f"before.{name}")
    return rules.ratio(F.array_size(F.array_intersect(before, now)), F.array_size(before))


def overlaps() -> dict[str, Column]:
    """Share of the previous sentence's lemmas found again."""
    return {"content_overlap_adjacent": _shared("content"),
            "noun_overlap_adjacent": _shared("nouns"),
            "argument_overlap_adjacent": _shared("arguments")}


def document_overlap(compat: bool = False) -> dict[str, Column]:
    """Share of the document's lemmas found in the sentence, over ``document.counts``.

    The words of a sentence are words of its document, so sizes are enough.
    """
    content = F.array_size(F.array_intersect("here.content", "here.words"))
    all_content = F.lit(0.0) if compat else later(rules.ratio(content, F.col("distinct_content")))
    return {"stem_overlap_all": later(rules.ratio(F.array_size("here.words"),
                                                  F.col("distinct_words"))),
            "content_overlap_all": all_content}


def _equal_pairs(a: Column, b: Column) -> Column:
    """Positions where both arrays have the same value; both missing is the same.

    ``zip_with`` fills the shorter array with null, hence the cut to common length.
    """
    n = F.least(F.array_size(a), F.array_size(b))
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return F.array_size(F.filter(F.slice(same, F.lit(1), n), lambda x: x))


def pos_dissimilarity() -> dict[str, Column]:
    now, before = F.col("here.pos"), F.col("before.pos")
    longest = F.greatest(F.array_size(now), F.array_size(before))
    differ = F.lit(1.0) - rules.ratio(_equal_pairs(before, now), longest)
    return {"pos_dissimilarity_prev": F.when(F.array_size(before) > 0, differ).otherwise(0.0)}


def word_dissimilarity() -> dict[str, Column]:
    """New words over the number of previous words; may exceed 1."""
    now, before = F.col("here.words"), F.col("before.words")
    return {"word_dissimilarity_prev": rules.ratio(
        F.array_size(F.array_except(now, before)), F.array_size(before))}


def verb_repetition() -> dict[str, Column]:
    """Over the previous verb tokens: shared lemmas (case kept), equal tense and aspect."""
    def pair(name: str) -> tuple[Column, Column]:
        return F.col(f"here.verbs.{name}"), F.col(f"before.verbs.{name}")

    n = F.array_size("before.verbs")
    now, before = pair("lemma")
    return {"verb_overlap_adjacent": rules.ratio(
                F.array_size(F.array_intersect(before, now)), n),
            "verb_tense_repetition": rules.ratio(_equal_pairs(*pair("tense")), n),
            "verb_aspect_repetition": rules.ratio(_equal_pairs(*pair("aspect")), n)}


def type_token_ratio() -> dict[str, Column]:
    """Distinct over all words of the sentence; ``_alpha`` counts the words."""
    return {"type_token_ratio": later(rules.ratio(F.array_size("here.words"), F.col("_alpha")))}


def semantic(similarity: Column) -> dict[str, Column]:
    """Embedding cohesion; the verb variant asks for a verb in both sentences."""
    def known(name: str) -> Column:
        return later(F.coalesce(similarity[name], F.lit(0.0)))

    both = (F.array_size("here.verbs") > 0) & (F.array_size("before.verbs") > 0)
    return {"lsa_overlap_adjacent": known("adjacent"),
            "lsa_overlap_all": known("mean_previous"),
            "lsa_given_new": later(1.0 - known("max_previous")),
            "lsa_verb_overlap_adjacent": F.when(both, known("adjacent")).otherwise(0.0)}
