"""Input tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text of one partition.  Its token rows take some 60 times as much in memory, and are sorted there.
PART_BYTES = 2 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(table: DataFrame) -> DataFrame:
    """A stored table over at least as many partitions as there are cores.

    Tokenizing is heavy work on few bytes, and a small file is one task.  Tables
    that already come in enough partitions are returned as they are, unshuffled.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def text_parts(docs: DataFrame, keys: Sequence[str], text: str = "text") -> tuple[int, bool]:
    """(partitions that the bytes of the texts ask, whether a key is null somewhere), by a job of its own;
    0 for few texts, which are left to the session's number."""
    null = F.greatest(F.lit(False), *[F.col(k).isNull() for k in keys])
    size, holes = docs.select(F.octet_length(text).alias("_size"), null.alias("_null")).agg(
        F.sum("_size"), F.max("_null")).first()
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (max(least, -(-size // PART_BYTES)) if (size or 0) > PART_BYTES else 0), bool(holes)


def by_keys(docs: DataFrame, keys: Sequence[str], text: str = "text", parts: int | None = None) -> DataFrame:
    """``docs`` spread by the keys over as many partitions as ``text_parts`` tells, so that the
    token rows of one fit in memory whatever the corpus."""
    parts = text_parts(docs, keys, text)[0] if parts is None else parts
    return docs.repartition(parts, *keys) if parts else docs.repartition(*keys)
