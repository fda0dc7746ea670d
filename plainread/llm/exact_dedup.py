"""Exact duplicates by content sort.

Sampled splitters range-partition the normalised bytes, Spark's external sort puts equal texts
next to each other, and each row is compared in full with its neighbour.  The sort key is a
bounded head of the bytes, their SHA-256, the bytes, and the id: the head gives content order, the
digest and the id keep the sampled splitters small and let one large group of copies span several
partitions.  Runs that touch a partition's border meet again by digest, with their bytes compared.

Defined results: null texts count as empty; empty texts are equal to each other; null ids come
last, so they are kept only in a group without any other id; rows that repeat an id and a text
stay separate rows of the same group, of which one is kept; an empty table gives an empty table;
other columns, whatever their names, are carried or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainread.llm.common import carried, type_of
from plainread.session import materialize

HEAD_BYTES = 64
CHUNK = 1024
NORMALIZE = {
    "none": lambda c: c,
    "lower": F.lower,
    "spaces": lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")),
}


def normalized(text: Column, how: str) -> Column:
    return NORMALIZE[how](F.coalesce(text, F.lit(""))).cast("binary")


def content_sorted(docs: DataFrame, text: str, doc_id: str, normalize: str, keep: str,
                   carry: bool) -> DataFrame:
    """(_id, _bytes, _sha [, _row]) range-partitioned and sorted by content, the id to keep first."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    rows = docs.select(F.col(doc_id).alias("_id"), normalized(F.col(text), normalize).alias("_bytes"),
                       *row)
    rows = rows.withColumn("_sha", F.sha2("_bytes", 256)).withColumn(
        "_head", F.substring("_bytes", 1, HEAD_BYTES))
    order = F.asc_nulls_last("_id") if keep == "smallest" else F.desc_nulls_last("_id")
    return (rows.repartitionByRange("_head", "_sha", order)
            .sortWithinPartitions("_head", "_sha", "_bytes", order).drop("_head"))


def run_starts(batch: pa.RecordBatch, last: bytes | None) -> tuple[list[bool], bytes | None]:
    """Whether each row differs in full from the row before it."""
    starts = []
    for value in batch.column("_bytes"):
        now = value.as_buffer()
        starts.append(last is None or not now.equals(last))
        last = now
    return starts, last


def copy_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                normalize: str = "none", keep: str = "smallest") -> DataFrame:
    """One row per document: (<doc_id>, keep_id, group_size, kept, text_sha256).

    ``keep`` is "smallest" or "largest" id.  The digest is that of the normalised bytes.
    """
    kind = type_of(docs, doc_id)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of at most CHUNK ids of a run; complete when run and chunk are the same and
        the run doesn't touch the partition's border."""
        part = TaskContext.get().partitionId()
        last, sha, content, ids, chunk, first_run = None, None, None, [], 0, True
        out: list[tuple] = []
        schema = None

        def close(ended: bool, border: bool) -> None:
            nonlocal ids, chunk
            edge = border and (ended or chunk == 0)
            out.append((sha, ids, part, chunk, ended and chunk == 0 and not border,
                        content.to_pybytes() if edge else None))
            ids, chunk = [], chunk + 1

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema)],
                                              names)
            out.clear()
            return made

        names = ["_sha", "_ids", "_part", "_chunk", "_complete", "_edge"]
        for rows in batches:
            schema = [pa.string(), pa.list_(rows.column("_id").type), pa.int64(), pa.int64(),
                      pa.bool_(), pa.binary()]
            starts, last = run_starts(rows, last)
            for i, start in enumerate(starts):
                if start:
                    if ids:
                        close(True, first_run)
                        first_run = False
                    chunk, sha = 0, rows.column("_sha")[i].as_py()
                    content = rows.column("_bytes")[i].as_buffer()
                elif len(ids) == CHUNK:
                    close(False, first_run)
                ids.append(rows.column("_id")[i].as_py())
                if len(out) >= 4096:
                    yield batch()
        if ids:
            close(True, True)
        if out:
            yield batch()

    schema = (f"_sha string, _ids array<{kind}>, _part bigint, _chunk bigint, _complete boolean, "
              "_edge binary")
    runs_table = materialize(content_sorted(docs, text, doc_id, normalize, keep, False)
                             .select("_id", "_bytes", "_sha").mapInArrow(runs, schema), "copies")
    whole = runs_table.filter("_complete").select(
        "_sha", "_ids", F.col("_ids")[0].alias("keep_id"),
        F.size("_ids").cast("bigint").alias("group_size"), F.lit(True).alias("_leads"))
    open_ = runs_table.filter("not _complete")
    place = F.struct("_part", "_chunk")
    same = F.coalesce(F.min("_edge") == F.max("_edge"), F.lit(True))
    totals = open_.groupBy("_sha").agg(
        F.min(F.struct("_part", "_chunk", F.col("_ids")[0].alias("keep_id"))).alias("_first"),
        F.when(same, F.sum(F.size("_ids"))).otherwise(
            F.raise_error(F.lit("two texts with one SHA-256"))).alias("group_size"))
    merged = open_.join(totals, "_sha").select(
        "_sha", "_ids", F.col("_first.keep_id").alias("keep_id"),
        F.col("group_size").cast("bigint").alias("group_size"),
        (place == F.struct("_first._part", "_first._chunk")).alias("_leads"))
    rows = whole.unionByName(merged).select(
        "*", F.posexplode("_ids").alias("_pos", doc_id))
    return rows.select(F.col(doc_id), "keep_id", "group_size",
                       (F.col("_leads") & (F.col("_pos") == 0)).alias("kept"),
                       F.col("_sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                normalize: str = "none", keep: str = "smallest") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    def leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, False
        for rows in batches:
            starts, last = run_starts(rows, last)
            kept = rows.filter(pa.array(starts, pa.bool_()))
            edge = [not seen] + [False] * (kept.num_rows - 1) if kept.num_rows else []
            seen = seen or kept.num_rows > 0
            first = pa.array([b if e else None for b, e in zip(kept.column("_bytes").to_pylist(), edge)]
                             if any(edge) else [None] * kept.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [kept.column("_row"), kept.column("_sha"), pa.array([part] * kept.num_rows, pa.int64()),
                 first], ["_row", "_sha", "_part", "_edge"])

    ordered = content_sorted(docs, text, doc_id, normalize, keep, True)
    found = materialize(ordered.select("_row", "_bytes", "_sha").mapInArrow(
        leaders, carried(ordered, "_row", "_sha string, _part bigint, _edge binary")), "leaders")
    # A run that opens a partition goes on from an earlier one if some earlier partition has its
    # text.  There is one such run a partition at most, so the two tables below are tiny.
    opening = found.filter(F.col("_edge").isNotNull()).groupBy(F.col("_sha").alias("_open")).agg(
        F.when(F.min("_edge") == F.max("_edge"), 1).otherwise(
            F.raise_error(F.lit("two texts with one SHA-256"))).alias("_same"))
    first = (found.join(F.broadcast(opening), F.col("_sha") == F.col("_open"))
             .groupBy("_open").agg(F.min("_part").alias("_least"), F.max("_same")))
    kept = found.join(F.broadcast(first), F.col("_sha") == F.col("_open"), "left")
    kept = kept.filter(F.col("_least").isNull() | (F.col("_part") == F.col("_least")))
    return kept.select("_row.*")
