"""Exact feature attributions of tree models: path-dependent Shapley values (Lundberg et al., 2018).

A tree's value for a row, were only some features known, is the mean over the leaves the known ones allow,
where an unknown split sends a row both ways by its cover, the training rows that went there.  A feature's
attribution is its Shapley value in this game; base and attributions add up to the prediction.

The fitted model is a node table (``node_table``): a row a node, read from the saved model.  Its paths, a
leaf each, are small beside any corpus and are sent to the tasks by size check; beyond the bound trees go in
several passes whose attributions add up.  In a task a path is worked out for a whole batch of rows: the
path's features extend a polynomial whose coefficients weigh the subsets by size, and each feature in turn
is unwound from it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainread.functions import wordlists as W
from plainread.session import new_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Paths that go to the tasks at once.
PATHS = 100_000
ROWS = 2048


@dataclass
class Split:
    """Rows with ``low`` < value <= ``high`` (or, of a categorical feature, a value among ``members``) go on;
    ``share`` is their part of the training rows."""

    feature: int
    low: float
    high: float
    share: float
    members: frozenset[float] | None = None

    def met(self, values: np.ndarray) -> np.ndarray:
        x = values[:, self.feature]
        if self.members is not None:
            return np.isin(x, list(self.members))
        return ~(x <= self.low) & (x <= self.high) | np.isnan(x) & (self.high == np.inf)


@dataclass
class Path:
    """A leaf: its value, weighed by its tree, and what leads there, one split a feature."""

    value: float
    splits: list[Split]


def node_table(spark: SparkSession, fitted: PipelineModel, path: str | None = None) -> DataFrame:
    """(tree, weight, id, prediction, cover, left, right, feature, threshold, categories): the nodes of the
    trees of a fitted pipeline's last stage.  The model is saved below ``path`` (default: the shared folder).

    ``left`` and ``right`` are -1 in leaves; ``categories`` is null unless the split is on a categorical
    feature, and then holds the values that go left.
    """
    model = fitted.stages[-1]
    path = path or new_path(spark, "trees")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    single = "nodeData" not in data.columns
    nodes = data.select(F.lit(0).alias("tree"), F.struct("*").alias("n")) if single else data.select(
        F.col("treeID").alias("tree"), F.col("nodeData").alias("n"))
    weights = [1.0] if single else list(model.treeWeights)
    if not single and type(model).__name__.startswith("RandomForest"):
        weights = [w / sum(weights) for w in weights]
    split = F.col("n.split")
    categorical = split["numCategories"] >= 0
    limits = split["leftCategoriesOrThreshold"]
    return nodes.select(
        "tree", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("tree") + 1).alias("weight"),
        F.col("n.id").alias("id"), F.col("n.prediction").alias("prediction"), F.col("n.rawCount").alias("cover"),
        F.col("n.leftChild").alias("left"), F.col("n.rightChild").alias("right"),
        split["featureIndex"].alias("feature"), F.when(~categorical, F.get(limits, F.lit(0))).alias("threshold"),
        F.when(categorical, limits).alias("categories"))


def tree_paths(nodes: Sequence, categories: int = 1 << 10) -> Iterator[Path]:
    """The paths of one tree, from its rows of the node table."""
    by_id = {n["id"]: n for n in nodes}

    def walk(node, splits: dict[int, Split]) -> Iterator[Path]:
        if node["left"] < 0:
            yield Path(node["weight"] * node["prediction"], list(splits.values()))
            return
        total = by_id[node["left"]]["cover"] + by_id[node["right"]]["cover"]
        for child, left in ((by_id[node["left"]], True), (by_id[node["right"]], False)):
            j = node["feature"]
            before = splits.get(j) or Split(j, -np.inf, np.inf, 1.0)
            low, high, members = before.low, before.high, before.members
            if node["categories"] is not None:
                chosen = set(node["categories"])
                held = members if members is not None else frozenset(map(float, range(categories)))
                members = frozenset(held & chosen if left else held - chosen)
            elif left:
                high = min(high, node["threshold"])
            else:
                low = max(low, node["threshold"])
            share = before.share * child["cover"] / total if total else 0.0
            yield from walk(child, {**splits, j: Split(j, low, high, share, members)})

    root = next(i for i in by_id if i not in {c for n in nodes for c in (n["left"], n["right"])})
    return walk(by_id[root], {})


def base_of(paths: Sequence[Path]) -> float:
    """The prediction when nothing is known: the mean over the training rows, as the covers tell."""
    return float(sum(p.value * np.prod([s.share for s in p.splits]) for p in paths))


def shapley(values: np.ndarray, paths: Sequence[Path]) -> np.ndarray:
    """The attributions (rows x features) that the paths give to rows of feature values."""
    out = np.zeros(values.shape)
    for path in paths:
        size = len(path.splits)
        if not size or not path.value:
            continue
        known = [s.met(values).astype(float) for s in path.splits]
        # Coefficient i: the weight of all subsets of i of the path's features.
        whole = np.zeros((len(values), size + 1))
        whole[:, 0] = 1.0
        for split, one in zip(path.splits, known):
            grown = whole * split.share
            grown[:, 1:] += whole[:, :-1] * one[:, None]
            whole = grown
        weights = subset_weights(size)
        for split, one in zip(path.splits, known):
            rest = unwound(whole, split.share, one)
            out[:, split.feature] += path.value * (one - split.share) * (rest @ weights)
    return out


def subset_weights(size: int) -> np.ndarray:
    """i! (size - 1 - i)! / size!: the share of the orders in which just i chosen features come first."""
    weights = np.empty(size)
    weights[0] = 1.0 / size
    for i in range(1, size):
        weights[i] = weights[i - 1] * i / (size - i)
    return weights


def unwound(whole: np.ndarray, share: float, one: np.ndarray) -> np.ndarray:
    """The coefficients without one feature: whole = rest * (share + one * t)."""
    size = whole.shape[1] - 1
    held = np.empty((len(whole), size))
    if share:
        out = whole[:, :size] / share  # rows that don't meet the split
    else:
        out = np.zeros((len(whole), size))
    left = whole[:, size].copy()
    for i in range(size - 1, -1, -1):  # rows that do, from the largest subsets down
        held[:, i] = left
        left = whole[:, i] - left * share
    return np.where(one[:, None] > 0, held, out)


def tree_attributions(means: DataFrame, nodes: DataFrame, keys: Sequence[str] = ("doc_id",),
                      features: Sequence[str] = W.FEATURES, paths_at_once: int = PATHS) -> DataFrame:
    """(keys, base, attributions named as the features) of each row of ``means``.

    ``nodes`` as ``node_table`` gives it; base + the sum of the attributions is the prediction.  Null
    features are missing values, which take no right turn of a threshold but the last.
    """
    trees: dict[int, list] = {}
    for node in nodes.collect():  # a fitted model, which lives on the driver anyway
        trees.setdefault(node["tree"], []).append(node)
    paths = [p for rows in trees.values() for p in tree_paths(rows)]
    values = F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(float("nan"))) for f in features])
    rows = means.select(*[F.col(f"`{k}`") for k in keys], values.alias("_values"))
    total = None
    for low in range(0, max(1, len(paths)), paths_at_once):
        part = attribute(paths[low:low + paths_at_once], len(features))(F.col("_values"))
        total = part if total is None else F.zip_with(total, part, lambda a, b: a + b)
    found = rows.select(*[F.col(f"`{k}`") for k in keys], total.alias("_found"))
    return found.select(*[F.col(f"`{k}`") for k in keys], F.lit(base_of(paths)).alias("base"),
                        *[F.col("_found")[i].alias(f) for i, f in enumerate(features)])


def attribute(paths: Sequence[Path], width: int):
    """shapley() over a column of arrays."""
    @F.arrow_udf("array<double>")
    def of_rows(column: pa.Array) -> pa.Array:
        values = np.asarray(column.flatten(), float).reshape(-1, width)
        made = [shapley(values[i:i + ROWS], paths) for i in range(0, len(values), ROWS)]
        flat = np.concatenate([np.empty((0, width)), *made]).reshape(-1)
        offsets = np.arange(len(values) + 1, dtype=np.int32) * width
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return of_rows.asNondeterministic()
