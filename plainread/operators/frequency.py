"""Word frequencies on the Zipf scale, counted from a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainread.operators.segment import sentence_array, token_array


def corpus_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word): every token of every sentence, lower-cased."""
    parts = F.transform(sentence_array(F.col(text)), token_array)
    return docs.select(F.explode(F.flatten(parts)).alias("word")).select(F.lower("word").alias("word"))


def word_zipf(words: DataFrame) -> DataFrame:
    """(word, n, zipf): zipf = log10 of occurrences per 10^9 tokens, 2 decimals.

    Counting is pre-aggregated on the map side, so a hot word costs one row per
    task.  The corpus total is a scalar subquery over the counts.
    """
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.select("word", "n", F.round(
        F.log10(F.col("n") * F.lit(1e9) / total), 2).alias("zipf"))
