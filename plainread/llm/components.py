"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainread.session import materialize


def components(links: DataFrame, left: str = "_a", right: str = "_b") -> DataFrame:
    """(_node, _root): each node of the links with the smallest node it reaches.

    Rounds of large-star and small-star (Kiveris et al., 2014): all neighbours of a node move to the
    smallest of them, until every component is a star.  The minimum is pre-aggregated where the
    links lie, and a node with many links meets it in a join whose hot keys Spark splits, so no
    neighbourhood is gathered.  Each round is written to the shared folder.
    """
    edges = links.select(F.col(left).alias("_u"), F.col(right).alias("_v")).filter("_u <> _v")
    edges = materialize(edges.select(F.greatest("_u", "_v").alias("_u"), F.least("_u", "_v").alias("_v"))
                        .distinct(), "links")
    before = None
    while True:
        # Large star: the larger neighbours of each node move to its least neighbour.
        both = edges.union(edges.select("_v", "_u"))
        least = both.groupBy("_u").agg(F.least(F.min("_v"), F.col("_u")).alias("_m"))
        moved = both.filter("_v > _u").join(least, "_u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v"))
        moved = moved.distinct()
        # Small star: the smaller neighbours, and the node itself, move to the least of them.
        lower = moved.groupBy("_u").agg(F.min("_v").alias("_m"))
        joined = moved.join(lower, "_u")
        edges = materialize(
            joined.filter("_v <> _m").select(F.col("_v").alias("_u"), F.col("_m").alias("_v"))
            .union(lower.select("_u", F.col("_m").alias("_v"))).distinct(), "links")
        # Stars stay as they are: nothing changes once the multiset of links repeats.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("_u", "_v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    tips = edges.select(F.col("_u").alias("_node"), F.col("_v").alias("_root"))
    return tips.union(tips.select(F.col("_root").alias("_node"), "_root").distinct())
