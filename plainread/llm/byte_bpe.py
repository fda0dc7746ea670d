"""Byte-level BPE by overlapping chunks.

A long text is cut into chunks of characters that overlap; chunks are pre-tokenised in parallel.
Whatever a chunk starts with, its matches soon fall on the boundaries its predecessor found, and
from the first common boundary on both agree, since a match depends only on what follows its
start.  Texts are stitched there: the characters between two such points are one piece of work,
and each pre-token in it is merged by itself.  Where two chunks share no boundary (a pre-token
longer than the overlap), the rest of
the text from the last common boundary on stays one piece.  Decoding
concatenates the raw bytes of the ids.

Defined results: null and empty texts have no ids; ids of repeated rows are found for each row; a
row is known by a number given on reading, so null or repeated ids do no harm; an empty table
gives an empty table; other columns are ignored.  Texts are whole; only a text's ids meet in one
row.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainread.llm.common import texts, type_of
from plainread.session import materialize

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 10
CACHE = 150_000
CACHED_CHARS = 32


class Codec:
    """Ranks of one vocabulary, with the merged ids of short pre-tokens remembered."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # A pattern that takes everything: the pre-token is already cut.
        self.merge = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks,
                                       special_tokens={}).encode_ordinary
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            by_id[i] = token
        self.tokens = pa.array(by_id, pa.large_binary())
        codec = self

        class Known(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = np.array(codec.merge(piece), "<u4").tobytes()
                if len(piece) <= CACHED_CHARS:
                    if len(self) >= CACHE:
                        self.clear()
                    self[piece] = ids
                return ids

        self.known = Known()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        """The raw bytes of the ids, one after another."""
        if not ids:
            return b""
        parts = self.tokens.take(pa.array(np.frombuffer(ids, "<u4")))
        ends = np.frombuffer(parts.buffers()[1], "<i8", len(parts) + 1, 8 * parts.offset)
        return parts.buffers()[2].to_pybytes()[ends[0]:ends[-1]]

    def starts(self, text: str) -> list[int]:
        return [m.start() for m in self.pattern.finditer(text)]


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def stitch_points(chunks: DataFrame, path: str, overlap: int) -> DataFrame:
    """(_row, _points): where neighbouring chunks of a text resynchronise, in order."""
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Boundaries within the overlaps at both ends of a chunk, as positions in the text.  The
        last match may be cut by the chunk's end, but its start is a boundary all the same."""
        tool = codec(path)
        for batch in batches:
            head, tail = [], []
            for begin, size, text in zip(batch.column("_begin").to_pylist(), batch.column("_step").to_pylist(),
                                         texts(batch, "_chunk")):
                at = np.array(tool.starts(text), np.int64)
                # Near the end a look-ahead may meet the cut, so the last overlap's end is left out.
                head.append(at[at < overlap // 2] + begin)
                tail.append(at[(at >= size) & (at < size + overlap // 2)] + begin)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("_no"), pa.array(head, pa.list_(pa.int64())),
                 pa.array(tail, pa.list_(pa.int64()))], ["_row", "_no", "_heads", "_tails"])

    found = chunks.mapInArrow(ends, "_row bigint, _no int, _heads array<bigint>, _tails array<bigint>")
    heads = found.select("_row", "_no", "_heads")
    tails = found.select("_row", (F.col("_no") + 1).alias("_no"), "_tails")
    # Chunk 0 starts at a true boundary; every later one is trusted from the first start it shares.
    met = heads.unionByName(tails, allowMissingColumns=True).groupBy("_row", "_no").agg(
        F.first("_heads", True).alias("h"), F.first("_tails", True).alias("t"))
    point = F.array_min(F.array_intersect("h", "t"))
    points = met.filter(F.col("_no") > 0).groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("_no", point.alias("at")))).alias("_all"),
        F.min(F.when(point.isNull(), F.col("_no"))).alias("_lost"))
    # Past a chunk that met none of its predecessor's boundaries nothing is proven.
    proven = F.filter("_all", lambda p: F.col("_lost").isNull() | (p["_no"] < F.col("_lost")))
    return points.select("_row", F.transform(proven, lambda p: p["at"]).alias("_points"))


def encode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None,
           chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """(<doc_id>, n_tokens, ids): ids as a binary of little-endian unsigned 32-bit integers."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("_id"), body.alias("_text"))
    kind = type_of(rows, "_id")

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            ids = pa.array([tool.encode(t) for t in texts(batch, "_text")], pa.large_binary())
            keep = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), ids.cast(pa.binary())],
                                             [*keep, "ids"])

    short = rows.filter(F.length("_text") <= chunk_chars).mapInArrow(ids_of, f"_id {kind}, ids binary")
    # Numbered once and written: every later step reads the same numbers, whatever is lost.
    long = materialize(rows.filter(F.length("_text") > chunk_chars).withColumn(
        "_row", F.monotonically_increasing_id()), "long-texts")
    begins = F.sequence(F.lit(0), F.length("_text") - 1, F.lit(chunk_chars))
    chunks = (long.select("_row", "_text", F.posexplode(begins).alias("_no", "_begin"))
              .select("_row", "_no", F.col("_begin").cast("bigint").alias("_begin"),
                      F.lit(chunk_chars).cast("bigint").alias("_step"),
                      F.substring("_text", F.col("_begin") + 1, F.lit(chunk_chars + overlap_chars)).alias("_chunk")))
    points = stitch_points(chunks.repartition("_row", "_no"), path, overlap_chars)
    cuts = F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint")), F.col("_points"),
                                     F.array(F.length("_text").cast("bigint"))))
    spans = (long.join(points, "_row").withColumn("_cuts", cuts)
             .select("_row", "_id", "_text", "_cuts", F.posexplode(
                 F.slice("_cuts", F.lit(1), F.size("_cuts") - 1)).alias("_no", "_from"))
             .select("_row", "_id", "_no", F.substring(
                 "_text", (F.col("_from") + 1).cast("int"),
                 (F.col("_cuts")[F.col("_no") + 1] - F.col("_from")).cast("int")).alias("_text")))
    pieces = spans.repartition("_row", "_no").mapInArrow(ids_of, f"_row bigint, _id {kind}, _no int, ids binary")
    joined = pieces.groupBy("_row").agg(
        F.first("_id").alias("_id"), F.array_sort(F.collect_list(F.struct("_no", "ids"))).alias("_all"))
    whole = joined.select("_id", F.unhex(F.array_join(
        F.transform("_all", lambda p: F.hex(p["ids"])), "")).alias("ids"))
    return short.unionByName(whole).select(
        F.col("_id").alias(doc_id), (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids")


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids",
           vocabulary: str | None = None) -> DataFrame:
    """``encoded`` with the binary column ``decoded``: the raw bytes of the ids."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            out = pa.array([tool.decode(v.as_py() or b"") for v in batch.column(ids)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(raw, f"{fields}, decoded binary")
