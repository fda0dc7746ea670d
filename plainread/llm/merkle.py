"""Merkle manifest of a dataset: a postorder append log built by aligned builders.

Rows are leaves.  The leaves of a group, in order, are hashed in runs of ``FAN``, level by level, to the
group's root; the roots of the groups, in order, likewise to the root of the dataset.

A tree is kept as a log of its nodes in the order in which an appending builder completes them, postorder:
after a leaf follow those of its ancestors that it completes.  The place of a node in the log follows
from its level, its index and the number of leaves alone (``place``), as every subtree to its left has
as many leaves as it can, so siblings are addressed without a search.

Builders are aligned: each takes the ``FAN`` ** ``HEIGHT`` nodes under one node and writes its piece of the
log as one row.  Their topmost nodes are the leaves of the next tier, until one is left.  A hot group is
spread over as many builders as it needs; leaves are numbered by a range sort, so no group meets in a task.

Proofs are read downwards: each builder takes the steps above it, adds those inside its piece, and hands
them to the builders below, last to the leaves.  A step is the place of the node in its run and its
siblings, addressed by ``place``.

Defined results: a null value enters as ``-``; groups with a null key come first; rows with one id are
ordered by their leaf, so copies are leaves of their own; null ids come first; an empty table has no leaves
and gives an empty table; columns that are not named don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plainread.llm.common import type_of
from plainread.operators.numbering import numbered
from plainread.session import materialize

FAN = 16
#: Levels that one builder completes.
HEIGHT = 2
SIZE = 32  # bytes of a digest
STEPS = "array<struct<slot:int,siblings:binary>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(values: Sequence[Column]) -> Column:
    """Digest (hex) of a row: of each value ``-`` if null, else its UTF-8 bytes after their count and a colon."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]), 256)


def place(level: int, index: int, leaves: int) -> int:
    """Where a node lies in the postorder log (from 0) of a tree over so many leaves."""
    last = min((index + 1) * FAN**level, leaves) - 1
    at = level
    while last:
        at, last = at + last, last // FAN
    return at


def counts(leaves: int, height: int | None = None) -> list[int]:
    """Nodes of each level from the leaves up: to the root, or to ``height``."""
    out = [leaves]
    while out[-1] > 1 if height is None else len(out) <= height:
        out.append(-(-out[-1] // FAN))
    return out


def digest(run: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join(run).hex().encode()).digest()


def postorder(leaves: Sequence[bytes], height: int | None) -> list[bytes]:
    """The log of a tree: each leaf, and after it the ancestors it completes.  With ``height`` the tree has
    just so many levels above the leaves, else one root."""
    sizes = counts(len(leaves), height)
    log, open_ = [], [[] for _ in sizes]
    for i, value in enumerate(leaves):
        log.append(value)
        open_[0].append(value)
        last = i + 1 == len(leaves)
        for level in range(len(sizes) - 1):
            if len(open_[level]) < FAN and not last:
                break
            value = digest(open_[level])
            open_[level] = []
            log.append(value)
            open_[level + 1].append(value)
    return log


def steps_of(log: bytes, leaves: int, index: int, height: int | None) -> list[tuple[int, bytes]]:
    """(place in its run, siblings) of a leaf and of its ancestors below the top, read from the log."""
    out = []
    sizes = counts(leaves, height)
    for level, size in enumerate(sizes[:-1]):
        begin = index // FAN * FAN
        run = [place(level, i, leaves) for i in range(begin, min(begin + FAN, size)) if i != index]
        out.append((index - begin, b"".join(log[SIZE * at:SIZE * (at + 1)] for at in run)))
        index //= FAN
    return out


def fold(value: bytes, steps: Sequence[tuple[int, bytes]]) -> bytes:
    """The root that follows from a leaf and its siblings."""
    for slot, siblings in steps:
        value = digest([siblings[:SIZE * slot], value, siblings[SIZE * slot:]])
    return value


def build_tier(nodes: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Builders (_key, _builder, _leaves, _whole, _log, _top, extra...) over nodes (_key, _at, _digest,
    extra...), whose extra columns become arrays.  ``_whole``: all of its tree, so ``_top`` is the root.  A
    tree that just fills a builder is not known to end there: it ends one tier above, as a tree of one node."""
    span = FAN**HEIGHT
    laid = nodes.withColumn("_builder", F.floor(F.col("_at") / span).cast("bigint")).repartition(
        "_key", "_builder").sortWithinPartitions("_key", "_builder", "_at")
    schema = T.StructType.fromDDL(
        "_key string, _builder bigint, _leaves int, _whole boolean, _log binary, _top binary"
        + "".join(f", {c} array<{type_of(nodes, c)}>" for c in extra))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digests, others = None, [], []

        def done() -> pa.RecordBatch:
            whole = now[1] == 0 and len(digests) < span
            log = postorder(digests, None if whole else HEIGHT)
            columns = [pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int64()),
                       pa.array([len(digests)], pa.int32()), pa.array([whole]),
                       pa.array([b"".join(log)], pa.binary()), pa.array([log[-1]], pa.binary())]
            for values in others:
                flat = pa.concat_arrays(values)
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            keys = list(zip(batch.column("_key").to_pylist(), batch.column("_builder").to_pylist()))
            values = batch.column("_digest").to_pylist()
            begin = 0
            while begin < len(keys):
                end = begin
                while end < len(keys) and keys[end] == keys[begin]:
                    end += 1
                if keys[begin] != now:
                    if digests:
                        yield done()
                    now, digests, others = keys[begin], [], [[] for _ in extra]
                digests += values[begin:end]
                for held, c in zip(others, extra):
                    held.append(batch.column(c).slice(begin, end - begin))
                begin = end
        if digests:
            yield done()

    return materialize(laid.mapInArrow(build, schema), "builders")


def build_trees(nodes: DataFrame, extra: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Tiers of builders from the leaves up, and the root of each tree (_key, _digest)."""
    tiers, roots = [], None
    while True:
        tier = build_tier(nodes, extra)
        tiers.append(tier)
        done = tier.filter("_whole").select("_key", F.col("_top").alias("_digest"))
        roots = done if roots is None else roots.union(done)
        rest = tier.filter("not _whole")
        if rest.isEmpty():
            return tiers, roots
        nodes, extra = rest.select("_key", F.col("_builder").alias("_at"), F.col("_top").alias("_digest")), ()


def paths(tiers: list[DataFrame], top: DataFrame) -> DataFrame:
    """The lowest builders with ``_steps`` from their topmost node up and ``_subroot``, by reading the logs
    downwards.  ``top`` (_key, _steps, _subroot): what lies above each tree's root."""
    above = None
    for tier in reversed(tiers[1:]):
        above = materialize(below(with_steps(tier, top, above)), "steps")
    return with_steps(tiers[0], top, above)


def with_steps(tier: DataFrame, top: DataFrame, above: DataFrame | None) -> DataFrame:
    """Trees that end in this tier, a builder each, start from ``top``, the others go on from ``above``."""
    own = tier.filter("_whole").join(top, "_key")
    if above is None:
        return own
    return own.unionByName(tier.filter("not _whole").join(above, ["_key", "_builder"]))


def below(tier: DataFrame) -> DataFrame:
    """(_key, _builder, _steps, _subroot) of the builders whose topmost nodes are the leaves of ``tier``."""
    span = FAN**HEIGHT

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                height = None if row["_whole"] else HEIGHT
                own = [[{"slot": slot, "siblings": siblings} for slot, siblings in
                        steps_of(row["_log"], row["_leaves"], i, height)] + row["_steps"] for i in range(row["_leaves"])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["_key"]] * len(own), pa.string()),
                     pa.array([row["_builder"] * span + i for i in range(len(own))], pa.int64()),
                     pa.array(own, pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.binary())]))),
                     pa.array([row["_subroot"]] * len(own), pa.string())],
                    ["_key", "_builder", "_steps", "_subroot"])

    return tier.select("_key", "_builder", "_leaves", "_whole", "_log", "_steps", "_subroot").mapInArrow(
        read, f"_key string, _builder bigint, _steps {STEPS}, _subroot string")


@dataclass
class Manifest:
    """tiers: logs of the groups' trees, by builder; groups: (_key, _steps, _subroot), the root of each group
    and the steps from it to the root of the dataset; root: (root), at most one row."""

    tiers: list[DataFrame]
    groups: DataFrame
    root: DataFrame


def ordered_key(column: Column) -> Column:
    """A text that is never null and sorts null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def build(docs: DataFrame, group: str = "source", order: str = "doc_id", fields: Sequence[str] = FIELDS,
          other: Column | None = None) -> Manifest:
    """The manifest of ``docs``: a tree a group, leaves by ``order``.  ``other`` is a second leaf (hex) kept
    beside the first, such as that of another version of the row; null where there is none."""
    none = F.lit(None).cast("string")
    rows = docs.select(ordered_key(F.col(f"`{group}`")).alias("_key"), F.col(f"`{order}`").alias("_ids"),
                       F.unhex(leaf([F.col(f"`{f}`") for f in fields])).alias("_digest"),
                       F.unhex(none if other is None else other).alias("_others"))
    rows = materialize(rows, "digests").withColumn("_order", F.struct("_ids", "_digest"))
    tiers, subroots = build_trees(numbered(rows, ["_key"], "_order", "_at").drop("_order"), ["_ids", "_others"])
    # The groups' roots are the leaves of one tree above.
    whole = materialize(numbered(subroots.withColumn("_all", F.lit("")), ["_all"], "_key", "_at"), "subroots")
    above, root = build_trees(whole.select(F.col("_all").alias("_key"), "_at", "_digest"))
    start = root.select("_key", F.array().cast(STEPS).alias("_steps"), F.lit("").alias("_subroot"))
    steps = below(paths(above, start)).select(F.col("_builder").alias("_at"), "_steps")
    groups = materialize(whole.join(steps, "_at").select(
        "_key", "_steps", F.lower(F.hex("_digest")).alias("_subroot")), "groups")
    return Manifest(tiers, groups, root.select(F.lower(F.hex("_digest")).alias("root")))


def log(manifest: Manifest) -> DataFrame:
    """(key, tier, level, index, place, digest): every node of the groups' trees and where it lies in the
    postorder log of its group; ``place`` runs from 0 without a gap."""
    span = FAN**HEIGHT
    out = None
    sizes = manifest.tiers[0].groupBy("_key").agg(F.sum("_leaves").alias("_n"))
    for number, tier in enumerate(manifest.tiers):
        def nodes(batches: Iterator[pa.RecordBatch], number: int = number) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    found = []
                    width = counts(row["_leaves"], None if row["_whole"] else HEIGHT)
                    # A tier's lowest nodes are the topmost of the tier below.
                    for level in range(1 if number else 0, len(width)):
                        for i in range(width[level]):
                            at = place(level, i, row["_leaves"])
                            up, index = number * HEIGHT + level, row["_builder"] * span // FAN**level + i
                            found.append((up, index, place(up, index, row["_n"]), row["_log"][SIZE * at:SIZE * (at + 1)].hex()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["_key"]] * len(found), pa.string()), pa.array([number] * len(found), pa.int32()),
                         *[pa.array([f[j] for f in found], pa.int64()) for j in range(3)],
                         pa.array([f[3] for f in found], pa.string())],
                        ["key", "tier", "level", "index", "place", "digest"])

        made = tier.join(sizes, "_key").select("_key", "_builder", "_leaves", "_whole", "_log", "_n").mapInArrow(
            nodes, "key string, tier int, level bigint, index bigint, place bigint, digest string")
        out = made if out is None else out.union(made)
    return out


def proofs(manifest: Manifest, order: str = "doc_id") -> DataFrame:
    """(<order>, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf: the digest of its
    siblings from the bottom up, the root that follows from them and its second leaf (else its own),
    and whether that is the root."""
    root = manifest.root.scalar()
    rows = paths(manifest.tiers, manifest.groups).select(
        "_ids", "_others", "_leaves", "_whole", "_log", "_steps", "_subroot", root.alias("_root"))
    kind = manifest.tiers[0].schema["_ids"].dataType.elementType
    schema = T.StructType([T.StructField(order, kind), *T.StructType.fromDDL(
        "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")])

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names if c != "_ids"}
                after = [(s["slot"], s["siblings"]) for s in row["_steps"]]
                upper = b"".join(s for _, s in after).hex().encode()
                height = None if row["_whole"] else HEIGHT
                found = []
                for i in range(row["_leaves"]):
                    own = steps_of(row["_log"], row["_leaves"], i, height)
                    spot = place(0, i, row["_leaves"])
                    value = row["_log"][SIZE * spot:SIZE * (spot + 1)]
                    proof = hashlib.sha256(b"".join(s for _, s in own).hex().encode() + upper).hexdigest()
                    folded = fold(row["_others"][i] or value, own + after).hex()
                    found.append((value.hex(), row["_subroot"], row["_root"], proof, folded, folded == row["_root"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_ids")[at].values, *[pa.array(c) for c in zip(*found)]], schema.names)

    return rows.mapInArrow(prove, schema)


def lower_az(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered_leaf(docs: DataFrame, every: int = 5, order: str = "doc_id", text: str = "text",
                  fields: Sequence[str] = FIELDS) -> Column:
    """Leaf of the row with its text's A-Z lower-cased, where ``every`` divides the crc32 of the id; else null."""
    changed = [lower_az(F.col(f"`{f}`")) if f == text else F.col(f"`{f}`") for f in fields]
    chosen = F.crc32(F.col(f"`{order}`").cast("string").cast("binary")) % every == 0
    return F.when(chosen, leaf(changed))
