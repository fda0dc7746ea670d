"""Shapley values of trees against the definition: all subsets of the features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from plainread.plans import attribution

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((200, 4))
    x[:, 3] = rng.integers(0, 4, 200)
    y = x[:, 0] * x[:, 1] + np.where(x[:, 3] % 2 == 0, 1.5, -1) + 0.1 * rng.standard_normal(200)
    return spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                                 "id bigint, a double, b double, c double, d double, label double").repartition(3)


def known_value(nodes, row, known, i=None):
    """The prediction when only the features ``known`` are: unknown splits go both ways by cover."""
    by_id = {n["id"]: n for n in nodes}
    node = by_id[min(by_id) if i is None else i]
    if node["left"] < 0:
        return node["prediction"]
    left, right = by_id[node["left"]], by_id[node["right"]]
    if node["feature"] in known:
        x = row[node["feature"]]
        goes_left = x in node["categories"] if node["categories"] is not None else x <= node["threshold"]
        return known_value(nodes, row, known, node["left"] if goes_left else node["right"])
    return sum(c["cover"] * known_value(nodes, row, known, c["id"]) for c in (left, right)) / (left["cover"] + right["cover"])


def brute(trees, row):
    out = [0.0] * len(row)
    for j in range(len(row)):
        others = [k for k in range(len(row)) if k != j]
        for size in range(len(row)):
            for some in combinations(others, size):
                weight = factorial(size) * factorial(len(row) - size - 1) / factorial(len(row))
                for nodes in trees.values():
                    out[j] += weight * nodes[0]["weight"] * (known_value(nodes, row, {*some, j}) - known_value(nodes, row, set(some)))
    return out


@pytest.mark.parametrize("kind,options,at_once", [
    (GBTRegressor, {"maxIter": 4, "maxDepth": 4, "seed": 0}, 100_000), (GBTRegressor, {"maxIter": 4, "maxDepth": 3, "seed": 0}, 5),
    (DecisionTreeRegressor, {"maxDepth": 6}, 100_000), (RandomForestRegressor, {"numTrees": 3, "maxDepth": 4, "seed": 1}, 100_000),
    (GBTRegressor, {"maxIter": 3, "seed": 0, "featuresCol": "indexed"}, 100_000)])
def test_attributions_are_shapley_values(spark, table, kind, options, at_once):
    regressor = kind(**options)
    stages = [VectorAssembler(inputCols=NAMES, outputCol="features")]
    if regressor.getFeaturesCol() == "indexed":  # d becomes a categorical feature
        stages.append(VectorIndexer(inputCol="features", outputCol="indexed", maxCategories=4))
    fitted = Pipeline(stages=[*stages, regressor]).fit(table)
    nodes = attribution.node_table(spark, fitted)
    got = attribution.tree_attributions(table, nodes, ["id"], NAMES, at_once).join(
        fitted.transform(table).select("id", "prediction", *[F.col(n).alias(f"x_{n}") for n in NAMES]), "id").collect()
    trees = {}
    for n in nodes.collect():
        trees.setdefault(n["tree"], []).append(n)
    assert any(n["categories"] is not None for t in trees.values() for n in t) == (len(stages) == 2)
    trees = {t: sorted(rows, key=lambda n: n["id"]) for t, rows in trees.items()}
    for r in got:
        assert r.base + sum(r[n] for n in NAMES) == pytest.approx(r.prediction)
    for r in got[:12]:
        row = [r[f"x_{n}"] for n in NAMES]
        assert [r[n] for n in NAMES] == pytest.approx(brute(trees, row), abs=1e-12)
        assert r.base == pytest.approx(sum(t[0]["weight"] * known_value(t, row, set()) for t in trees.values()))


def test_attributions_of_odd_rows(spark, table):
    fitted = Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="features"), DecisionTreeRegressor()]).fit(table)
    nodes = attribution.node_table(spark, fitted)
    odd = spark.createDataFrame([(None, None, 1.0, 2.0, 3.0), (1, float("nan"), 1.0, 2.0, 3.0), (1, 1e300, -1e300, 0.0, 9.0)],
                                "id bigint, a double, b double, c double, d double")
    got = attribution.tree_attributions(odd, nodes, ["id"], NAMES).collect()
    assert len(got) == 3 and got[0][1:] == got[1][1:]
    assert attribution.tree_attributions(odd.limit(0), nodes, ["id"], NAMES).collect() == []
    constant = Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="features"), DecisionTreeRegressor()]).fit(
        table.withColumn("label", F.lit(2.5)))
    got = attribution.tree_attributions(table.limit(2), attribution.node_table(spark, constant), ["id"], NAMES).collect()
    assert [tuple(r)[1:] for r in got] == [(2.5, 0.0, 0.0, 0.0, 0.0)] * 2


def test_unwinding_undoes_extending():
    whole = np.array([[1.0, 0.0, 0.0, 0.0]])
    for share, one in ((0.3, 1.0), (0.5, 0.0), (0.9, 1.0)):
        whole = whole * share + np.c_[[0.0], whole[:, :-1] * one]
    rest = attribution.unwound(whole, 0.5, np.array([0.0]))
    assert rest[0] == pytest.approx([0.27, 0.3 + 0.9, 1.0])
    assert attribution.subset_weights(3) == pytest.approx([1 / 3, 1 / 6, 1 / 3])
