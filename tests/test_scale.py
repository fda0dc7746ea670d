"""The plans hold at size: partitions follow the bytes, lookups beyond the broadcast bound move no token rows."""

import numpy as np
from pyspark.sql import functions as F

from plainread.operators import annotate, frequency
from plainread.plans import profile
from plainread.session import materialize
from tests.test_operators import docs_of


def rows_of(spark, n=40):
    return docs_of(spark, *[f"Dogs barked {i} times. The cat was seen by dog{i} and word{chr(97 + i % 26)}x." for i in range(n)])


def partitions(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_partitions_follow_the_bytes_of_the_texts(spark, monkeypatch):
    texts = rows_of(spark)
    monkeypatch.setattr("plainread.sources.tables.PART_BYTES", 100)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0]
    for made in (profile.profile_tokens(texts, semantic=False), annotate.token_table(texts)):
        assert made.rdd.getNumPartitions() == -(-size // 100)
        assert partitions(made) > 8


def test_suffixes_are_the_longest(spark):
    from plainread.functions import rules

    words = ["classes", "boxes", "dishes", "flies", "tried", "s", "this", "glass", "bus", "running", "lyx", "", None]
    found = spark.createDataFrame([(w,) for w in words], "w string").select(rules.suffix_of(F.col("w")).alias("s")).collect()
    assert [r.s for r in found] == ["sses", "xes", "shes", "ies", "ied", "s", "is", "ss", "us", "ing", "", "", None]


def test_tables_beyond_the_broadcast_bound_move_no_token_rows(spark, monkeypatch):
    monkeypatch.setattr("plainread.sources.tables.PART_BYTES", 100)
    monkeypatch.setattr("plainread.operators.lookup.HEAD_ROWS", 3)
    for texts in (rows_of(spark), rows_of(spark).union(rows_of(spark, 3)), rows_of(spark).selectExpr(
            "nullif(doc_id, 1) as doc_id", "text")):
        zipf = materialize(frequency.word_zipf(frequency.corpus_words(texts)))
        norms = materialize(zipf.select("word", *[F.length("word").cast("double").alias(n) for n in (
            "aoa", "concreteness", "familiarity", "imagery")]))
        small, large = (profile.profile_flat(profile.sentence_features(texts, zipf=zipf, norms=norms, limit=limit))
                        for limit in (1 << 26, 0))
        assert small.exceptAll(large).count() == 0 and large.exceptAll(small).count() == 0 < small.count()
        if texts.filter("doc_id is null").isEmpty():
            large.collect()
            plan = large._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
            assert moved and "ShuffledHashJoin" in plan
            assert not any("_salt" in line or "sent_id" in line for line in moved)


def test_every_training_row_teaches_the_languages(spark):
    from plainread.llm import language_id

    draw = np.random.default_rng(3).integers(97, 123, (9000, 12), np.uint8)
    rows = [("en", bytes(r).decode()) for r in draw]
    train = spark.createDataFrame(rows, "lang string, text string")
    _, plain = language_id.fit_plain(train)
    tool = language_id.Encoder(language_id.DIMENSIONS, language_id.GRAM)
    whole = sum(language_id.unit(v).astype(float).sum(axis=0) for v in tool.batches(t for _, t in rows))
    assert abs(plain[0] - language_id.unit(whole)).max() < 1e-5


def test_a_task_hands_on_each_query_once(spark):
    from plainread.llm import ann

    vectors = np.random.default_rng(1).normal(size=(300, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    found = ann.search(table, F.col("vec_id") % 20 == 0, k=5, leaf_rows=20)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" not in plan
    rows = found.collect()
    assert len(rows) == 15 * 5
    scores = np.array([r.score for r in sorted(rows, key=lambda r: (r.query_id, r.rank))]).reshape(15, 5)
    assert (np.diff(scores, axis=1) <= 0).all()


def test_bounds_are_learned_from_every_row(spark):
    from plainread.llm import language_id

    texts = [(lang, f"{word} {i} " * 8) for i in range(30) for lang, word in (("en", "the words of dogs"), ("de", "die worte der hunde"))]
    train = spark.createDataFrame(texts, "lang string, text string")
    names, plain = language_id.fit_plain(train)
    whole, part = language_id.fit_bounds(train, names, plain), language_id.fit_bounds(train, names, plain, sample_rows=10**6)
    assert (whole.least == part.least).all() and (whole.least > -1).any()
