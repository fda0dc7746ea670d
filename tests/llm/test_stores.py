"""Archives, neighbours, components and the pipeline against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from plainread.llm import ann, exact_dedup, jaccard_join, suffix_dedup, warc
from plainread.llm.components import components
from plainread.llm.queries import all_queries
from tests.conftest import SF


def test_warc_round_trip(spark):
    big, other = "ä" * 700, "x" * 1000
    rows = [(1, "u1", big), (2, "u2", big), (3, None, big), (4, "u4", "small"), (5, "u5", "small"), (6, "u6", None),
            (7, "u7", ""), (8, "u8", other), (8, "u8", other), (9, "u9", big + "1")]
    pages = spark.createDataFrame([(*r, "a", 1) for r in rows],
                                  "page_id bigint, url string, html string, file string, offset int").repartition(3)
    index = warc.write(pages, warc.new_archive(pages))
    got = warc.read(index).collect()
    assert len(got) == len(rows)
    kinds = {r.record_id: (r.record_type, r.refers_to, r.payload_bytes) for r in got}
    assert kinds["1"] == ("revisit", "3", 1400) and kinds["2"][1] == "3" and kinds["3"] == ("response", None, 1400)
    assert kinds["4"][0] == kinds["5"][0] == kinds["8"][0] == kinds["9"][0] == "response"
    for r in got:
        if r.record_type == "response":
            assert r.payload.decode() == next(h or "" for i, _, h in rows if str(i) == r.record_id)
    # Selected records alone, by single reads and by coalesced ones.
    chosen = index.filter("page_id in (2, 4, 9)")
    for gap in (0, 1 << 20):
        assert sorted(r.record_id for r in warc.read(chosen, gap_bytes=gap).collect()) == ["2", "4", "9"]
    assert warc.ranges(index, gap_bytes=1 << 20).count() <= index.select("file").distinct().count()
    none = warc.write(pages.limit(0), warc.new_archive(pages))
    assert none.count() == 0 and warc.read(none).count() == 0


def test_warc_query_of_odd_pages(spark, tmp_path):
    """Null ids, line ends and field names in URLs, null and empty pages, an empty table."""
    big = "p" * 1200
    rows = [(1, "http://a/\r\n\r\nb", big), (2, "x\r\nWARC-Type: revisit", "one"), (None, "http://n", big), (None, None, "two"),
            (3, "a\nb\tc\x00d\x85e", None), (4, "http://ok/%41?q=1", big), (5, "", "")]
    schema = "page_id bigint, url string, html string"
    pages = spark.createDataFrame(rows, schema)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    found = all_queries()["op3_warc"](spark, str(tmp_path)).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in found) == [
        (False, 1, 1200, "revisit", 4), (False, 2, 3, "response", None), (False, 3, 0, "response", None),
        (False, 4, 1200, "response", None), (False, 5, 0, "response", None),
        (True, 0, 3, "response", None), (True, 0, 1200, "revisit", 4)]
    index = warc.write(pages, warc.new_archive(pages))
    assert {r.url for r in index.collect()} == {u or "" for _, u, _ in rows}
    assert {r.url for r in warc.read(index).collect()} == {
        "http://a/%0D%0A%0D%0Ab", "x%0D%0AWARC-Type: revisit", "http://n", "", "a%0Ab%09c%00d%C2%85e", "http://ok/%41?q=1"}
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert all_queries()["op3_warc"](spark, f"{tmp_path}/none").collect() == []


def test_warc_ids_of_any_text(spark):
    names = ["a b", "x>\r\nWARC-Type: revisit", "null", "%41", "", "é"]
    pages = spark.createDataFrame([(n, "u", "h" * i) for i, n in enumerate(names)], "page_id string, url string, html string")
    got = {r.record_id: r.payload_bytes for r in warc.read(warc.write(pages, warc.new_archive(pages))).collect()}
    assert got == {n: i for i, n in enumerate(names)}


def test_warc_reads_in_several_tasks(spark):
    pages = spark.range(300).selectExpr("id as page_id", "'u' as url", "repeat(sha2(cast(id as string), 512), 20) as html").repartition(4)
    index = warc.write(pages, warc.new_archive(pages))
    found = warc.read(index, range_bytes=20_000, gap_bytes=0)
    parts = found.select(F.spark_partition_id().alias("p"), "record_id").collect()
    assert len(parts) == 300 and len({r.p for r in parts}) > 1


def exact_neighbours(rows, is_query, k):
    fine = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, a in fine:
        if is_query(q):
            near = sorted((-float(a @ b), i) for i, b in fine if i != q)[:k]
            out[q] = [i for _, i in near]
    return out


def test_ann(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(16)]) for i in range(600)]
    same = rows[7][1]
    rows += [(i, same) for i in range(600, 900)]  # one vector in a third of all rows
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] + [1.0] * 15), (1060, [None] + [1.0] * 15)]
    table = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "vec_id bigint, embedding array<float>, rank int, score double")
    got = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0, 20, leaf_rows=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r["score"]))
    rounded = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = exact_neighbours([(i, v) for i, v in rounded if v is not None and None not in v], lambda q: q % 20 == 0, 20)
    assert set(got) == set(want)
    hits = 0
    vectors = dict(rounded)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert all(abs(s - float(np.dot(vectors[q], vectors[i]))) < 1e-9 for _, i, s in found)
        hits += len({f[1] for f in found} & set(want[q]))
    assert hits >= 0.9 * 20 * len(want)
    hot = sorted(got[600])
    assert [f[1] for f in hot][:20] == want[600]  # ties by the smaller id
    few = table.filter("vec_id in (0, 1, 2)")
    assert ann.search(few, F.col("vec_id") == 0, 20).count() == 2
    assert ann.search(table.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_ann_gives_k_rows(spark):
    """One tile, every query's own vector the best: the k-th neighbour is there all the same."""
    vectors = np.random.default_rng(6).standard_normal((400, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = exact_neighbours(rows, lambda q: q % 20 == 0, 20)
    got = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [v for _, v in sorted(found)] for q, found in got.items()} == want
    assert all([i for i, _ in sorted(found)] == list(range(1, 21)) for found in got.values())
    again = table.union(spark.createDataFrame([(0, [x * (2 + i) for x in rows[0][1]]) for i in range(25)], table.schema))
    found = ann.search(again, (F.col("vec_id") == 0) & (F.element_at("embedding", 1) == rows[0][1][0]), 20).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"])] == want[0]  # its own id has the 26 best vectors


def test_ann_ids_of_any_type(spark):
    """Null ids take no part; texts and short integers are ids as well, ties by their order."""
    vectors = np.random.default_rng(8).standard_normal((60, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(61, [float(x) for x in vectors[3]])]
    table = spark.createDataFrame([*rows, (None, rows[0][1]), (None, rows[5][1])], "vec_id int, embedding array<double>")
    want = exact_neighbours(rows, lambda q: q % 20 == 0, 5)
    got = ann.search(table, F.col("vec_id") % 20 == 0, 5)
    assert dict(got.dtypes)["vec_id"] == dict(got.dtypes)["query_id"] == "int"
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == sorted(
        (q, i + 1, v) for q, found in want.items() for i, v in enumerate(found))
    named = table.withColumn("vec_id", F.format_string("v%02d", "vec_id")).withColumn(
        "vec_id", F.when(F.col("vec_id") != "vnull", F.col("vec_id")))
    got = ann.search(named, F.col("vec_id").isin("v00", "v20", "v40", "v60"), 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(
        (f"v{q:02}", i + 1, f"v{v:02}") for q, found in want.items() for i, v in enumerate(found))


def test_ann_counts_no_own_vector(spark):
    """A query's own vector, always in the first leaf it visits, is no hit of the calibration."""
    tree = ann.Tree(np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]]), [[1, 2], [], []], [-1, 0, 1])
    index = spark.createDataFrame([([1.0, 0.9], [7], 7, 0), ([0.5, 0.6], [8], 8, 1)],
                                  "_vector array<double>, _ids array<bigint>, _first bigint, _leaf bigint")
    queries = spark.createDataFrame([(7, [1.0, 0.9])], "_query bigint, _asked array<double>")
    assert ann.calibrated(index, queries, tree, 1, 0.5, 10) == 2


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [
        (rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r["_node"]: r["_root"] for r in components(spark.createDataFrame(pairs, "_a bigint, _b bigint")).collect()}
    assert got == {x: find(x) for x in root if any(x in p for p in pairs if p[0] != p[1])}
    assert components(spark.createDataFrame([], "_a bigint, _b bigint")).count() == 0


def test_pipeline(spark):
    """Each stage against what its operator says of its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.filter('doc_id < 3').union(docs.filter("doc_id = 5").withColumn("text", F.lit(None).cast("string"))).union(
        docs.filter("doc_id = 6").withColumn("text", F.lit("12 !!")))
    number = F.when(F.col("text").isNull(), 1_000_001).when(F.col("text") == "12 !!", 1_000_002).otherwise(
        F.col("doc_id") + 2_000_000)
    docs = exact_dedup.materialize(docs.union(extra.withColumn("doc_id", number.cast("bigint"))).select(
        "*", F.lit(1).alias("kept")))
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = exact_dedup.materialize(stage(spark, before, SF), name)
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        if name != "packing":
            assert after.columns == docs.columns
        left = {r.doc_id for r in after.select("doc_id").distinct().collect()}
        if name == "language_id":
            assert ids - left == {r.doc_id for r in before.filter("text is null or text = '12 !!'").collect()}
        elif name == "exact_dedup":
            best = {}
            for r in before.collect():
                best[r.text] = max(best.get(r.text, -1), r.doc_id)
            assert left == set(best.values())
        elif name == "jaccard_join":
            groups = jaccard_join.near_groups(before, words=5, percent=80).collect()
            assert left == {r.component_id for r in groups}
        elif name == "suffix_dedup":
            kept = {r.doc_id: r.kept for r in suffix_dedup.remove_repeats(before, as_text=True).collect()}
            assert {r.doc_id: r.text for r in after.collect()} == kept
            assert after.filter("n_chars <> length(text)").count() == 0
        else:
            assert left == ids
        before = after
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_queries_are_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(all_queries()) < set(names) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in all_queries()) == list(range(1, 11))
