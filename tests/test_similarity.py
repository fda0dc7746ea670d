"""Similarities with earlier rows: null groups, bounds on the sphere, plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plainread.functions import kernels
from plainread.operators import embedding

SCHEMA = "g string, h bigint, at long, v array<double>"


def brute(rows):
    """(g, h, at) -> (adjacent, mean, best)"""
    out, groups = {}, {}
    for g, h, at, v in sorted(rows, key=lambda r: r[2]):
        x = np.zeros(6) if v is None else np.array(v)
        groups.setdefault((g, h), []).append((at, x / np.linalg.norm(x) if x.any() else x))
    for (g, h), found in groups.items():
        for i, (at, x) in enumerate(found):
            cosines = [float(x @ y) for _, y in found[:i]]
            out[g, h, at] = (cosines[-1], np.mean(cosines), max(cosines)) if cosines else (0.0, 0.0, None)
    return out


@pytest.mark.parametrize("stripe", [4, 13, 1000])
def test_null_groups_and_null_vectors(spark, stripe):
    rng = np.random.default_rng(stripe)
    rows = []
    for g, h, n in ((None, 1, 40), ("a", None, 13), ("a", 1, 2), (None, None, 1), ("b", 2, 26), ("c", 3, 4)):
        rows += [(g, h, i * 3 - 50, None if i == 3 else [0.0] * 6 if i == 4 else rng.normal(size=6).tolist()) for i in range(n)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows)
    got = embedding.previous_similarity(table, ["g", "h"], "at", "v", stripe).collect()
    near = {(r.g, r.h, r.at): r.adjacent for r in embedding.adjacent_cosine(table, ["g", "h"], "at", "v", stripe).collect()}
    assert len(got) == len(near) == len(rows)
    for r in got:
        adjacent, mean, best = want[r.g, r.h, r.at]
        assert r.adjacent == pytest.approx(adjacent) and near[r.g, r.h, r.at] == pytest.approx(adjacent)
        assert r.mean_previous == pytest.approx(mean)
        assert r.max_previous == (None if best is None else pytest.approx(best))
    empty = embedding.previous_similarity(table.limit(0), ["g", "h"], "at", "v", stripe)
    assert empty.collect() == [] and embedding.adjacent_cosine(table.limit(0), ["g", "h"], "at", "v").collect() == []


def drifting(rng, topics, each, spread):
    centres = np.linalg.qr(rng.normal(size=(24, 24)))[0][:topics]
    return np.vstack([c + spread * rng.normal(size=(each, 24)) for c in centres])


def test_blocks_that_cannot_win_are_skipped(monkeypatch):
    monkeypatch.setattr(kernels, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = kernels.unit(drifting(rng, 12, 32, 0.05))
    best, skipped = kernels.best_earlier(rows)
    inner = rows @ rows.T
    inner[np.triu_indices(len(rows))] = -np.inf
    assert best == pytest.approx(inner.max(axis=1))
    # Of 276 pairs of blocks all but those of a topic with itself (12) and of its first row, which has none near (132).
    assert skipped >= 130
    random = kernels.unit(rng.normal(size=(100, 3)))
    random[7] = 0
    inner = random @ random.T
    inner[np.triu_indices(100)] = -np.inf
    assert kernels.best_earlier(random)[0] == pytest.approx(inner.max(axis=1))


def test_tiles_that_cannot_win_are_left_out(spark):
    rng = np.random.default_rng(4)
    vectors = drifting(rng, 10, 20, 0.05)
    rows = [("hot", 1, i, v.tolist()) for i, v in enumerate(vectors)]
    balls = [kernels.ball(kernels.unit(vectors[i:i + 20])) for i in range(0, 200, 20)]
    summary = [("hot", i, c.tolist(), a, z, 0.7) for i, (c, a, z) in enumerate(balls)]
    stripes = spark.createDataFrame(summary, "g string, _stripe bigint, _centre array<double>, _angle double, _zero boolean, _least double")
    assert embedding.open_tiles(stripes, ["g"]).count() == 0  # of 45
    assert embedding.open_tiles(stripes.withColumn("_least", F.lit(-1.0)), ["g"]).count() == 45
    got = embedding.previous_similarity(spark.createDataFrame(rows, SCHEMA), ["g", "h"], "at", "v", 20).collect()
    unit = kernels.unit(vectors)
    inner = unit @ unit.T
    for r in got:
        if r.at:
            assert r.max_previous == pytest.approx(inner[r.at, :r.at].max())
            assert r.mean_previous == pytest.approx(inner[r.at, :r.at].mean())


def test_small_groups_cost_one_exchange(spark):
    table = spark.createDataFrame([("a", 1, i, [1.0, float(i)]) for i in range(9)], SCHEMA)
    found = embedding.previous_similarity(table, ["g", "h"], "at", "v")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
