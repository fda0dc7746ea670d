"""Licence texts by diagonal voting, in DataFrame operations alone.

Every rolling k-gram of a document's words is joined with the k-grams of licence templates, which are
broadcast up to a size and shuffled by their hash beyond it.  A hit
votes for the diagonal document position - template position.  Votes are summed per document,
template and diagonal; diagonals next to each other (words put in or left out) are merged, and
the merged span is verified: the share of the template's k-grams it holds decides.  A template that
must be exact needs all its k-grams on one diagonal.

Words are runs of letters and digits of any script, A-Z lower-cased, as are the templates' words.

Defined results: null and empty texts have no words and no labels; templates shorter than k words
are refused; repeated rows get a row each, also under a null id; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plainread.llm.common import keyed

K = 2
#: Neighbouring diagonals up to this distance are one span.
DRIFT = 3
#: Share of a template's k-grams that a span must hold.
COVERAGE = 0.6
#: Votes a diagonal needs to count.
MIN_VOTES = 2
#: Words of all templates up to which they are broadcast.
BROADCAST_WORDS = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Exact phrases and their labels: fixed values.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: Notices that name a licence, and opening passages of licence texts; found by coverage.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
            "and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except "
               "in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the "
            "gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mit", "released under the mit license"),
)


def lowered(text: Column) -> Column:
    """A-Z as a-z.  Lower-casing other letters changes no word border and no match, except that
    the Kelvin sign would become a k, so it is taken out of the way first."""
    return F.lower(F.replace(text, F.lit("K"), F.lit("ĸ")))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def templates(spark: SparkSession, exact: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]],
              k: int) -> DataFrame:
    """(_template, _label, _exact, _grams, _at, _gram): the k-grams of every template."""
    rows = [(i, label, i < len(exact), text.split()) for i, (label, text) in enumerate([*exact, *notices])]
    if any(len(r[3]) < k for r in rows):
        raise ValueError(f"a template has fewer than {k} words")
    small = sum(len(r[3]) for r in rows) <= BROADCAST_WORDS
    if small:
        table = spark.range(1).select(F.inline(F.array(*[F.struct(
            F.lit(i).alias("_template"), F.lit(label).alias("_label"), F.lit(whole).alias("_exact"),
            F.array(*map(F.lit, words)).alias("_words")) for i, label, whole, words in rows])))
    else:
        table = spark.createDataFrame(rows, "_template int, _label string, _exact boolean, _words array<string>")
    at = F.explode(F.sequence(F.lit(0), F.size("_words") - k)).alias("_at")
    sheet = table.select("_template", "_label", "_exact", (F.size("_words") - (k - 1)).alias("_grams"),
                        "_words", at).select(
        "_template", "_label", "_exact", "_grams", "_at", gram_hash("_words", "_at", k).alias("_key"),
        *[F.col("_words")[F.col("_at") + i].alias(f"_w{i}") for i in range(k)])
    return F.broadcast(sheet) if small else sheet


def gram_hash(words: str, at: str, k: int) -> Column:
    return F.xxhash64(*[F.col(words)[F.col(at) + i] for i in range(k)])


def votes(docs: DataFrame, sheet: DataFrame, text: str, doc_id: str, k: int) -> DataFrame:
    """(_row, _mark, template columns, _diagonal, _ats): the template places hit on each diagonal."""
    rows = docs.select(*keyed(docs, text, doc_id), words_of(F.col(text)).alias("_words"))
    places = rows.filter(F.size("_words") >= k).select(
        "_row", "_mark", "_words", F.explode(F.sequence(F.lit(0), F.size("_words") - k)).alias("_place"))
    grams = places.withColumn("_hash", gram_hash("_words", "_place", k))
    # Joined by hash, and the words themselves compared.
    same = F.col("_hash") == F.col("_key")
    for i in range(k):
        same &= F.col("_words")[F.col("_place") + i] == F.col(f"_w{i}")
    hits = grams.join(sheet, same)
    # Rows that repeat an id and a text hit the same places: each place counts once.
    return hits.groupBy("_row", "_mark", "_template", "_label", "_exact", "_grams",
                        (F.col("_place") - F.col("_at")).alias("_diagonal")).agg(
        F.collect_set("_at").alias("_ats"))


def spans(voted: DataFrame, k: int, drift: int, coverage: float) -> DataFrame:
    """(_row, _mark, _label, _exact, _begin, _last, _share): verified spans, in words."""
    exact = voted.filter("_exact and size(_ats) = _grams").select(
        "_row", "_mark", "_label", "_exact", F.col("_diagonal").alias("_begin"),
        (F.col("_diagonal") + F.col("_grams") + (k - 2)).alias("_last"), F.lit(1.0).alias("_share"))
    # A single common k-gram is no diagonal.
    loose = voted.filter(~F.col("_exact") & (F.size("_ats") >= F.least(F.lit(MIN_VOTES), F.col("_grams"))))
    key = ["_row", "_mark", "_template"]
    order = Window.partitionBy(*key).orderBy("_diagonal")
    opens = F.when(F.col("_diagonal") - F.lag("_diagonal").over(order) <= drift, 0).otherwise(1)
    band = loose.withColumn("_opens", opens).withColumn("_band", F.sum("_opens").over(order))
    merged = band.groupBy(*key, "_label", "_exact", "_grams", "_band").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("_ats")))).alias("_held"),
        F.min(F.col("_diagonal") + F.array_min("_ats")).alias("_begin"),
        F.max(F.col("_diagonal") + F.array_max("_ats") + (k - 1)).alias("_last"))
    share = F.col("_held") / F.col("_grams")
    words = F.col("_last") - F.col("_begin") + 1
    verified = merged.filter((share >= coverage) & (words <= 2 * (F.col("_grams") + (k - 1))))
    return exact.union(verified.select(
        "_row", "_mark", "_label", "_exact", "_begin", "_last", share.alias("_share")))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
         exact: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES,
         k: int = K, drift: int = DRIFT, coverage: float = COVERAGE) -> DataFrame:
    """(<doc_id>, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    Base columns are of exact phrases: all places, their smallest and largest first word.  ``labels``
    adds those of verified notices.  ``spans`` lists (label, first word, last word, share).  The score
    is the largest share of a template held: 1 with a base phrase, 0 without any span.
    """
    sheet = templates(docs.sparkSession, exact, notices, k)
    found = spans(votes(docs, sheet, text, doc_id, k), k, drift, coverage)

    def joined(only: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(only, F.col("_label")))), ",")

    by_doc = found.groupBy("_row", "_mark").agg(
        F.count_if("_exact").alias("n_base"), F.min(F.when(F.col("_exact"), F.col("_begin"))).alias("first_word"),
        F.max(F.when(F.col("_exact"), F.col("_begin"))).alias("last_word"),
        joined(F.col("_exact")).alias("base_labels"), joined(F.lit(True)).alias("labels"),
        F.max("_share").alias("score"), F.sort_array(F.collect_list(F.struct(
            F.col("_begin").alias("first"), F.col("_last").alias("last"), F.col("_label").alias("label"),
            F.col("_share").alias("share")))).alias("spans"))
    sizes = docs.select(F.col(doc_id), *keyed(docs, text, doc_id),
                        F.size(words_of(F.col(text))).cast("bigint").alias("n_words"))
    empty = F.array().cast("array<struct<first:int,last:int,label:string,share:double>>")
    return sizes.join(by_doc, ["_row", "_mark"], "left").select(
        F.col(doc_id), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"),
        F.col("first_word").cast("bigint").alias("first_word"), F.col("last_word").cast("bigint").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", empty).alias("spans"))
