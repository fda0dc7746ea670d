"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, best bin first.

The tree is fitted on a bounded sample of distinct vectors and its nodes are broadcast; every row
is put into one leaf.  A query descends with a priority queue: of all open nodes the one whose
centre has the largest inner product is opened next, so leaves come in the order of promise.  How many
leaves a query visits is calibrated: a bounded sample of queries is answered exactly over all rows, and
visits are widened until the sample's recall is reached.

Equal vectors are searched once, with the smallest ids that can matter (k and the query's own).  A
leaf's rows and its visitors are cut into tiles of bounded size by hash; a tile is one matrix product,
and gives the best of each of its queries.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part as
queries or candidates, nor do rows with a null id; ids may be of any type that can be ordered; ties go to the
smaller id; rows that repeat an id are candidates each, never of
their own id; an empty table gives an empty table; other columns are ignored.  Vectors of several
lengths are an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plainread.llm.common import type_of
from plainread.operators.numbering import numbered
from plainread.session import materialize

#: Bounds of the samples: vectors the tree is fitted on, queries that are answered exactly.
SAMPLE_ROWS = 20_000
CALIBRATION_ROWS = 256
BRANCHES = 8
LEAF_ROWS = 2048
LEAST_SAMPLE = 8
RECALL = 0.95
TILE_ROWS, TILE_QUERIES = 2048, 512
SPARE = 16
#: Queries whose finds a task holds before it passes them on.
HELD_QUERIES = 1 << 14
NEAR = pa.list_(pa.struct([("less", pa.float64()), ("vec_id", pa.int64())]))


@dataclass
class Tree:
    centres: np.ndarray  # a row a node; node 0 is the root
    children: list[list[int]]
    leaf: list[int]  # the leaf's number, -1 at inner nodes

    @property
    def leaves(self) -> int:
        return max(self.leaf, default=-1) + 1

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf reached by way of the nearest centre at each node."""
        out = np.zeros(len(vectors), np.int64)
        open_ = [(0, np.arange(len(vectors)))]
        while open_:
            node, rows = open_.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            best = nearest(vectors[rows], self.centres[kids])
            open_ += [(kid, rows[best == i]) for i, kid in enumerate(kids) if (best == i).any()]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        out, queue = [], [(0.0, 0)]
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                continue
            kids = self.children[node]
            for near, kid in zip((self.centres[kids] @ query).tolist(), kids):
                heapq.heappush(queue, (-near, kid))
        return out


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * vectors @ centres.T).argmin(axis=1)


def grow(sample: np.ndarray, leaf_rows: int, branches: int) -> Tree:
    """Splits a bounded sample until nodes have ``leaf_rows`` rows at most."""
    random = np.random.default_rng(11)
    tree = Tree(np.empty((0, sample.shape[1])), [], [])
    centres = [sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])]
    open_ = [(0, sample)]
    tree.children.append([])
    tree.leaf.append(-1)
    while open_:
        node, rows = open_.pop()
        part = split(rows, branches, random) if len(rows) > leaf_rows else None
        if part is None:
            tree.leaf[node] = tree.leaves
            continue
        for i in np.unique(part):
            kid = len(centres)
            centres.append(rows[part == i].mean(axis=0))
            tree.children.append([])
            tree.leaf.append(-1)
            tree.children[node].append(kid)
            open_.append((kid, rows[part == i]))
    tree.centres = np.array(centres)
    return tree


def split(rows: np.ndarray, branches: int, random: np.random.Generator) -> np.ndarray | None:
    """Lloyd's k-means of one node; None where it finds no two parts."""
    centres = rows[random.choice(len(rows), min(branches, len(rows)), replace=False)]
    for _ in range(12):
        part = nearest(rows, centres)
        centres = np.array([rows[part == i].mean(axis=0) if (part == i).any() else centres[i]
                            for i in range(len(centres))])
    part = nearest(rows, centres)
    return part if len(np.unique(part)) > 1 else None


def usable(vector: Column) -> Column:
    value = vector.cast("array<double>")
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & fine & F.exists(value, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.empty((0, 0))
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(float)


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row by row, so that equal pairs give equal scores wherever they stand."""
    return np.einsum("ij,ij->i", queries, vectors)


def best_of(queries: np.ndarray, vectors: np.ndarray, first_ids: np.ndarray, k: int
            ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places, scores) of the k best vectors of each query, ties by first id."""
    near = queries @ vectors.T
    take = min(len(vectors), k + SPARE)
    for i in range(len(queries)):
        if take < len(vectors):
            edge = np.partition(near[i], -take)[-take]
            at = np.flatnonzero(near[i] >= edge - 1e-9)  # rounding must not part equal scores
        else:
            at = np.arange(len(vectors))
        exact = scores(np.broadcast_to(queries[i], (len(at), queries.shape[1])), vectors[at])
        order = np.lexsort((first_ids[at], -exact))[:k]
        yield i, at[order], exact[order]


def others(ids: pa.Array, at: np.ndarray, exact: np.ndarray, own: int, k: int) -> list[dict]:
    """The k best rows of the vectors ``at``, best first, but those of the query's own id."""
    best: list[dict] = []
    for p, s in zip(at.tolist(), exact.tolist()):
        if len(best) == k:
            break
        best += [{"less": -s, "vec_id": v} for v in ids[p].as_py() if v != own][:k - len(best)]
    return best


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(_vector, _ids): each vector once with its k + 1 smallest ids.  The limit by rank is applied
    before the shuffle as well, so a vector in a third of all rows reaches one task in few rows."""
    rank = F.row_number().over(Window.partitionBy("_vector").orderBy("_id"))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= k + 1).groupBy("_vector").agg(
        F.array_sort(F.collect_list("_id")).alias("_ids"))


def search(table: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding",
           recall: float = RECALL, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS,
           calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row of ``table``.

    Ids that are no integers are numbered in their order, searched by number and put back.
    """
    kind = type_of(table, vec_id)
    rows = table.select(F.col(f"`{vec_id}`").alias("_id"), F.col(f"`{vector}`").cast("array<double>").alias("_vector"),
                        F.coalesce(is_query, F.lit(False)).alias("_asks")).filter(F.col("_id").isNotNull())
    tuning = (k, recall, leaf_rows, sample_rows, calibration_rows)
    if kind in ("bigint", "int", "smallint", "tinyint"):
        found = nearest_rows(rows.withColumn("_id", F.col("_id").cast("bigint")), *tuning)
        return found.select(F.col("query_id").cast(kind), "rank", F.col("vec_id").cast(kind), "score")
    names = materialize(numbered(rows.select(F.lit(0).alias("_all"), "_id").distinct(), ["_all"], "_id", "_no")
                        .select("_id", "_no"), "names")
    found = nearest_rows(rows.join(names, "_id").select(F.col("_no").alias("_id"), "_vector", "_asks"), *tuning)
    for column in ("query_id", "vec_id"):
        found = found.join(names.select(F.col("_no").alias(column), F.col("_id").alias("_name")), column).drop(
            column).withColumnRenamed("_name", column)
    return found.select("query_id", "rank", "vec_id", "score")


def nearest_rows(rows: DataFrame, k: int, recall: float, leaf_rows: int, sample_rows: int,
                 calibration_rows: int) -> DataFrame:
    """The search over (_id, _vector, _asks) with bigint ids."""
    fine = rows.filter(usable(F.col("_vector")))
    rows = fine.select("_id", "_vector")
    queries = fine.filter("_asks").select(F.col("_id").alias("_query"), F.col("_vector").alias("_asked")).distinct()
    distinct = materialize(distinct_vectors(rows, k).withColumn(
        "_first", F.col("_ids")[0]), "vectors")
    total = distinct.count()
    drawn = F.pmod(F.xxhash64("_vector"), F.lit(1 << 30)) < F.lit(
        min(1.0, sample_rows / max(1, total)) * (1 << 30))
    sample = matrix(distinct.filter(drawn).select("_vector").toArrow().column(0).combine_chunks())
    if not len(sample):  # no vector at all
        sample = np.zeros((0, 1))
    share = len(sample) / max(1, total)
    tree = grow(sample, max(LEAST_SAMPLE, int(leaf_rows * share)), BRANCHES)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.assign(matrix(batch.column("_vector")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)],
                                                 [*batch.schema.names, "_leaf"])

    fields = "_vector array<double>, _ids array<bigint>, _first bigint, _leaf bigint"
    index = materialize(distinct.mapInArrow(place, fields), "index")
    most = calibrated(index, queries, tree, k, recall, calibration_rows)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [tree.visits(q, most) for q in matrix(batch.column("_asked"))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))],
                                                 [*batch.schema.names, "_leaves"])

    asked = materialize(queries.mapInArrow(visit, "_query bigint, _asked array<double>, _leaves array<bigint>"
                                           ).withColumn("_leaf", F.explode("_leaves")).drop("_leaves"), "visits")
    # A row a leaf: the number of leaves is bounded by the sample.
    size = index.groupBy("_leaf").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("_rows"))
    visitors = asked.groupBy("_leaf").agg(F.ceil(F.count("*") / TILE_QUERIES).cast("int").alias("_visits"))
    cuts = F.broadcast(size.join(visitors, "_leaf"))
    none = F.lit(None)
    left = index.join(cuts, "_leaf").select(
        "_leaf", F.pmod(F.xxhash64("_first"), F.col("_rows")).cast("int").alias("_i"),
        F.explode(F.sequence(F.lit(0), F.col("_visits") - 1)).alias("_j"), F.lit(1).alias("_kind"),
        F.col("_first").alias("_number"), "_vector", "_ids")
    right = asked.join(cuts, "_leaf").select(
        "_leaf", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)).alias("_i"),
        F.pmod(F.xxhash64("_query"), F.col("_visits")).cast("int").alias("_j"), F.lit(0).alias("_kind"),
        F.col("_query").alias("_number"), F.col("_asked").alias("_vector"), none.cast("array<bigint>").alias("_ids"))
    tile = ["_leaf", "_i", "_j"]
    laid = left.union(right).repartition(*tile).sortWithinPartitions(*tile, "_kind", "_number")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        best: dict[int, list[dict]] = {}

        def merged(found: Iterator[tuple[int, list[dict]]]) -> Iterator[pa.RecordBatch]:
            """A query's finds in all tiles of the task are one list of k; many queries are passed on."""
            for asked, near in found:
                best[asked] = sorted(best.get(asked, []) + near, key=lambda c: (c["less"], c["vec_id"]))[:k]
            if len(best) > HELD_QUERIES:
                yield passed_on()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), NEAR)],
                                             ["query_id", "near"])
            best.clear()
            return out

        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in tile], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                now = tuple(keys[a])
                if key is not None and now != key:
                    yield from merged(products(held))
                    held = []
                key = now
                held.append(batch.slice(a, b - a))
        if held:
            yield from merged(products(held))
        yield passed_on()

    def products(held: list[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
        rows_ = pa.Table.from_batches(held).combine_chunks()
        kind = np.asarray(rows_.column("_kind").combine_chunks())
        number = np.asarray(rows_.column("_number").combine_chunks())
        vectors = matrix(rows_.column("_vector").combine_chunks())
        n = int((kind == 0).sum())
        if not n or n == len(kind):
            return
        ids = rows_.column("_ids").combine_chunks().slice(n)
        # k distinct vectors hold the k best rows, and the query's own may be one more.
        for i, at, exact in best_of(vectors[:n], vectors[n:], number[n:], k + 1):
            own, wide = int(number[i]), k + 1
            best = others(ids, at, exact, own, k)
            while len(best) < k and wide < len(vectors) - n:  # its id is repeated with other vectors
                wide *= 2
                _, at, exact = next(best_of(vectors[i:i + 1], vectors[n:], number[n:], wide))
                best = others(ids, at, exact, own, k)
            yield own, best

    found = laid.mapInArrow(multiply, "query_id bigint, near array<struct<less: double, vec_id: bigint>>")
    # A task passes on one list of k candidates of a query; rows are made of the k that are left.
    nearest = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    return found.groupBy("query_id").agg(nearest.alias("near")).select("query_id", F.posexplode("near").alias(
        "_at", "_one")).select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_one.vec_id").alias("vec_id"),
                               (-F.col("_one.less")).alias("score"))


def calibrated(index: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float, rows: int) -> int:
    """The fewest leaf visits that reach ``recall`` on a bounded sample of queries, answered exactly."""
    if tree.leaves <= 1:
        return 1
    chosen = queries.orderBy(F.xxhash64("_query"), "_query").limit(rows).collect()
    if not chosen:
        return 1
    numbers = [r["_query"] for r in chosen]
    asked = np.array([r["_asked"] for r in chosen], float)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of each batch for every query of the sample."""
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, first = matrix(batch.column("_vector")), np.asarray(batch.column("_first"))
            leaf, last = np.asarray(batch.column("_leaf")), np.asarray(batch.column("_last"))
            out = [np.empty(0, np.int64)] * 3 + [np.empty(0)]
            parts = []
            for i, at, s in best_of(asked, vectors, first, k + 1):
                # A vector that only the query's own id has is no hit, it is always reached.
                hit = (first[at] != numbers[i]) | (last[at] != numbers[i])
                parts.append((np.full(hit.sum(), i), first[at][hit], leaf[at][hit], s[hit]))
            if parts:
                out = [np.concatenate([p[c] for p in parts]) for c in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["_q", "_first", "_leaf", "_s"])

    found = index.select("_vector", "_first", F.element_at("_ids", -1).alias("_last"), "_leaf").mapInArrow(
        exact, "_q bigint, _first bigint, _leaf bigint, _s double")
    rank = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("_s"), "_first"))
    top = found.withColumn("_rank", rank).filter(F.col("_rank") <= k).select("_q", "_leaf").collect()
    wanted: dict[int, list[int]] = {}
    for r in top:
        wanted.setdefault(r["_q"], []).append(r["_leaf"])
    reached = np.zeros(tree.leaves)
    for q, leaves in wanted.items():
        place = {leaf: i for i, leaf in enumerate(tree.visits(asked[q], tree.leaves))}
        for leaf in leaves:
            reached[place[leaf]] += 1
    share = np.cumsum(reached) / max(1, len(top))
    return int(np.argmax(share >= recall)) + 1 if numbers else 1
