"""Places of rows in groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plainread.session import materialize


def numbered(rows: DataFrame, keys: Sequence[str], order: str, name: str = "_pos") -> DataFrame:
    """``rows`` with their place (from 0) in their group by ``order``, whatever its values.

    Rows are range-sorted and written; each partition numbers its part of a group, and the parts
    before it are added from a table of one row a part.  No group meets in one task.
    """
    keys = list(keys)
    placed = materialize(rows.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
                         .withColumn("_part", F.spark_partition_id()), "numbered")
    inside = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(order)) - 1
    parts = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    joined = placed.withColumn("_inside", inside).alias("rows").join(bases.alias("bases"), [
        F.col(f"rows.{k}").eqNullSafe(F.col(f"bases.{k}")) for k in [*keys, "_part"]])
    return joined.select("rows.*", (F.col("bases._base") + F.col("rows._inside")).cast("bigint").alias(name)
                         ).drop("_part", "_inside")
