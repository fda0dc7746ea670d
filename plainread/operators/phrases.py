"""Multi-word connectives of a rule set of any size, counted per sentence.

A phrase is a row: its category, its pattern, and the words it opens with.  A sentence's words and pairs of
neighbouring words are rows too; they meet the phrases by an equi-join on the opening words, and only the
sentences and phrases that meet are verified by the pattern.  So the work follows the matches, not the
number of phrases, and no category has to be known beforehand.

In a phrase "..." stands for any words between.  Occurrences don't overlap, as with the built-in lists
(``surface.phrase_counts``).  Phrases of one word are no business of this module, nor are null or blank
ones; a phrase listed twice in a category counts once; sentences of null text have no phrases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainread.operators.embedding import null_safe
from plainread.session import materialize

WORDS = r"[\p{L}\p{N}]+"
BOUND = r"\b"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def pattern_of(phrase: Column) -> Column:
    """Regular expression of a lower-cased phrase; its words as they are, whatever signs they hold."""
    pieces = F.transform(F.split(phrase, r"\.\.\."), lambda p: F.regexp_replace(
        F.regexp_replace(F.trim(p), r"([^\p{L}\p{N}\s])", r"\\$1"), r"\s+", " "))
    return F.concat(F.lit(BOUND), F.array_join(pieces, rf"{BOUND}.*?{BOUND}"), F.lit(BOUND))


def phrase_rows(ruleset: DataFrame) -> DataFrame:
    """(category, _pattern, _opening) of the multi-word phrases of ``ruleset`` (category, phrase).

    The opening is the first two words if no gap and no sign but a blank lies between, else the first.
    """
    phrase = F.lower(F.trim("phrase"))
    rows = ruleset.select("category", phrase.alias("_phrase")).filter(F.col("_phrase").contains(" ")).distinct()
    pair = F.regexp_extract("_phrase", rf"^({WORDS}) +({WORDS})(?:\s|$)", 0)
    opening = F.when(pair != "", F.array_join(words_of(pair), " ")).otherwise(
        F.regexp_extract("_phrase", WORDS, 0))
    return rows.select("category", pattern_of(F.col("_phrase")).alias("_pattern"), opening.alias("_opening")).filter(
        F.col("_opening") != "")


def phrase_counts(sentences: DataFrame, ruleset: DataFrame, keys: Sequence[str] = ("doc_id",),
                  text: str = "text") -> DataFrame:
    """(keys, sent_id, category, n) of the sentences (keys, sent_id, text) that hold phrases of the
    category.  ``sentences`` are read twice: words first, then the sentences to verify."""
    place = [*keys, "sent_id"]
    phrases = materialize(phrase_rows(ruleset), "phrases")
    words = words_of(F.lower(F.col(text)))
    pairs = F.transform(F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("b")),
                        lambda p: F.concat_ws(" ", p["a"], p["b"]))
    openings = sentences.filter(F.col(text).isNotNull()).select(
        *place, F.explode(F.array_distinct(F.concat(words, pairs))).alias("_opening"))
    met = openings.join(phrases, "_opening").select(*place, "category", "_pattern").distinct()
    checked = null_safe(met, sentences.select(*place, F.lower(F.col(text)).alias("_lower")), place)
    found = checked.select(*place, "category", F.regexp_count("_lower", F.col("_pattern")).cast("bigint").alias("n"))
    return found.filter("n > 0").groupBy(*place, "category").agg(F.sum("n").alias("n"))


def phrase_columns(sentences: DataFrame, ruleset: DataFrame, categories: Sequence[str],
                   keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """(keys, sent_id, <category>_phrases ...) of every sentence, 0 where it has none."""
    place = [*keys, "sent_id"]
    counts = phrase_counts(sentences, ruleset, keys, text).groupBy(*place).agg(*[
        F.sum(F.when(F.col("category") == c, F.col("n"))).alias(f"{c}_phrases") for c in categories])
    rows = null_safe(sentences.select(*place), counts, place, "left")
    return rows.select(*place, *[F.coalesce(f"{c}_phrases", F.lit(0)).cast("bigint").alias(f"{c}_phrases")
                                 for c in categories])
