"""Document-wide features from token rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plainread.functions import rules
from plainread.functions import wordlists as W


def lemma_sets(tokens: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Sorted distinct lemma arrays per document: content, noun, verb, word, argument.

    Reduced to one row per document and lemma first, so the arrays are gathered from distinct lemmas.
    """
    pos = F.col("pos")
    kinds = {"content_lemmas": rules.one_of(pos, W.CONTENT_POS), "noun_lemmas": pos == "NOUN",
             "verb_lemmas": pos == "VERB", "all_stems": F.lit(True),
             "argument_lemmas": rules.one_of(F.col("dep"), W.ARGUMENT_DEP)}
    lemmas = tokens.groupBy(*keys, F.when(F.col("is_alpha"), F.col("base")).alias("_lemma")).agg(
        *[F.bool_or(kind).alias(n) for n, kind in kinds.items()])
    return lemmas.groupBy(*keys).agg(*[
        F.array_sort(F.collect_list(F.when(F.col(n), F.col("_lemma")))).alias(n) for n in kinds])


def counts(tokens: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keys, distinct_words, distinct_content, distinct_verbs, total_words, total_verbs).

    Reduced to one row per document and lemma first, so distinct counting is a
    plain count and nothing is gathered.
    """
    pos, n = F.col("pos"), F.count("*")
    lemmas = tokens.filter("is_alpha").groupBy(*keys, F.col("base").alias("lemma")).agg(
        n.alias("n"), F.count_if(pos == "VERB").alias("as_verb"),
        F.count_if(rules.one_of(pos, W.CONTENT_POS)).alias("as_content"))
    return lemmas.groupBy(*keys).agg(
        F.count("*").alias("distinct_words"),
        F.count_if(F.col("as_content") > 0).alias("distinct_content"),
        F.count_if(F.col("as_verb") > 0).alias("distinct_verbs"),
        F.sum("n").alias("total_words"), F.sum("as_verb").alias("total_verbs"))


def first_uses(tokens: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Token rows that tell whether a lemma is new to its document: as any word (_new_word), as a
    content word (_new_content), as a verb (_new_verb).

    Counting these is counting distinct lemmas, in the pass that makes the sentence rows: rows are
    already together by document, so the window sorts and moves nothing.
    """
    pos = F.col("pos")
    so_far = (Window.partitionBy(*keys, "base").orderBy("sent_id", "tok_idx")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kinds = {"_new_word": F.lit(True), "_new_content": rules.one_of(pos, W.CONTENT_POS),
             "_new_verb": pos == "VERB"}
    return tokens.select("*", *[
        (F.col("is_alpha") & kind & (F.count_if(F.col("is_alpha") & kind).over(so_far) == 1)).alias(n)
        for n, kind in kinds.items()])


def sentence_counts() -> dict[str, Column]:
    """Aggregates over the rows of ``first_uses``, per sentence; their sums over a document are
    those of ``counts``."""
    alpha = F.col("is_alpha")
    return {"distinct_words": F.count_if("_new_word"), "distinct_content": F.count_if("_new_content"),
            "distinct_verbs": F.count_if("_new_verb"), "total_words": F.count_if(alpha),
            "total_verbs": F.count_if(alpha & (F.col("pos") == "VERB"))}


def diversity() -> dict[str, Column]:
    """Distinct over total lemmas, of all words and of verbs, over ``counts``."""
    return {"lexical_diversity_all": rules.ratio(F.col("distinct_words"), F.col("total_words")),
            "lexical_diversity_verbs": rules.ratio(F.col("distinct_verbs"), F.col("total_verbs"))}
