"""Phrases of a loaded rule set against the built-in patterns."""

import re

from pyspark.sql import functions as F

from plainread.functions import wordlists as W
from plainread.operators import phrases, segment, surface
from plainread.sources.tables import read_table

from .conftest import SF


def test_same_as_the_built_in_lists(spark):
    sentences = segment.sentences(read_table(spark, SF, "documents").select("doc_id", "text"))
    rules = spark.createDataFrame([(c, p) for c, words in W.CONNECTIVES.items() for p in words], "category string, phrase string")
    got = phrases.phrase_columns(sentences, rules, list(W.CONNECTIVES))
    want = sentences.select("doc_id", "sent_id", *[c.alias(n) for n, c in surface.phrase_counts(F.col("text")).items()])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_any_file(spark):
    texts = ["In the end, not only cats but in the end also dogs. e.g. this (so called) thing, so  called",
             "As AS as well as well as a matter of fact", "nothing", None, "", "matter of matter of fact", "C++ code is c++ code"]
    listed = [("time", "in the end"), ("time", "in the end"), ("time", " In The "), ("add", "not only ... also"), ("add", "as well"),
              ("add", "as well as"), ("own", "e.g. this"), ("own", "so called"), ("own", "matter of fact"), ("own", "c++ code"),
              ("own", "single"), ("own", None), ("own", "  "), (None, "in the"), ("own", "? !")]
    sentences = spark.createDataFrame([(i if i != 2 else None, 0, t) for i, t in enumerate(texts)], "doc_id int, sent_id int, text string")
    rules = spark.createDataFrame(listed, "category string, phrase string")
    got = {(r.doc_id, r.category): r.n for r in phrases.phrase_counts(sentences, rules).collect()}
    want = {}
    for i, t in enumerate(texts):
        for c, p in {(c, " ".join(p.lower().split())) for c, p in listed if p and " " in p.strip() and re.search(r"\w", p)}:
            n = len(re.findall(surface.phrase_pattern(p), (t or "").lower()))
            if n:
                want[i, c] = want.get((i, c), 0) + n
    assert got == want
    wide = phrases.phrase_columns(sentences, rules, ["own", "absent"]).collect()
    assert len(wide) == len(texts) and sum(r.own_phrases for r in wide) == sum(n for (_, c), n in want.items() if c == "own")
    assert phrases.phrase_counts(sentences, rules.limit(0)).collect() == []


def test_many_phrases_need_no_pattern_each(spark):
    """A rule set of 20,000 phrases: the sentences meet it by a join, not by an expression a phrase."""
    rules = spark.range(20_000).select(F.lit("many").alias("category"), F.concat(F.lit("word"), F.col("id"), F.lit(" next")).alias("phrase"))
    sentences = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(0).alias("sent_id"), F.concat(
        F.lit("a word"), F.col("id") * 150, F.lit(" next word7 next")).alias("text"))
    got = phrases.phrase_counts(sentences, rules).collect()
    assert len(got) == 200 and sum(r.n for r in got) == 200 + 134
