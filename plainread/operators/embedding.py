"""Sentence embeddings and the similarities of each sentence with earlier ones.

Two ways in, one result ``(adjacent, mean_previous, max_previous)``:

* ``document_similarity``: the built-in hashed term-frequency provider, on the
  document row, where the group is one text;
* ``previous_similarity``: a caller's embedding table, where a group can be of
  any size; a large one is cut into stripes.

A zero vector has cosine 0 with everything.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plainread.functions import kernels, rules
from plainread.functions import wordlists as W
from plainread.operators.numbering import numbered
from plainread.session import materialize

STRIPE = 16384          # rows of one side of a tile: 16384 x 384 doubles = 50 MB
SIMILARITY = "adjacent double, mean_previous double, max_previous double"


def sentence_buckets(sentence: Column, width: int = W.EMBEDDING_WIDTH) -> Column:
    """Hash buckets of the lower-cased letter words of a sentence, in order."""
    words = F.regexp_extract_all(F.lower(sentence), F.lit(W.WORD_PATTERN), F.lit(0))
    return F.transform(words, lambda w: rules.hash_bucket(w, width))


def document_similarity(sents: Column, idf: Sequence[float] | None = None,
                        width: int = W.EMBEDDING_WIDTH) -> Column:
    """array<struct> of similarities, one per sentence of the array ``sents``.

    Only bucket numbers and sentence sizes go to Python: two flat integer arrays.
    """
    weights = None if idf is None else np.asarray(idf, dtype=float)

    @F.pandas_udf(f"array<struct<{SIMILARITY.replace(' double', ': double')}>>")
    def similarity(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for buckets, sizes in parts:
            yield pd.Series([
                None if s is None else kernels.one_document(
                    np.asarray(b, dtype=int), np.asarray(s, dtype=int), width, weights)
                for b, s in zip(buckets, sizes)], dtype=object)

    # A single sentence has nothing before it, whatever its words.
    buckets = F.when(F.array_size(sents) == 1, F.array(F.array().cast("array<int>"))).otherwise(
        F.transform(sents, lambda s: sentence_buckets(s, width)))
    return similarity(F.flatten(buckets), F.transform(buckets, F.array_size))


def counted_cells(sentences: DataFrame, keys: Sequence[str] = ("doc_id",),
                  width: int = W.EMBEDDING_WIDTH) -> DataFrame:
    """(keys, sent_id, cell, tf): how often a sentence's words fall into each cell; a row with a
    null cell stands for the sentence itself, so that none is lost.

    Each word is hashed once, on a row of its own.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(W.WORD_PATTERN), F.lit(0))
    rows = sentences.select(*keys, "sent_id", F.explode(
        F.concat(words, F.array(F.lit(None).cast("string")))).alias("word"))
    rows = rows.select(*keys, "sent_id", rules.hash_bucket(F.col("word"), width).alias("cell"))
    return rows.groupBy(*keys, "sent_id", "cell").agg(F.count("*").alias("tf"))


def weighted_cells(cells: DataFrame) -> DataFrame:
    """``cells`` with value = tf ln((n + 1) / (df + 1)); ``cells`` should be materialized.

    The document frequencies and the number of sentences are one aggregate of a row a cell, which
    bounds what is broadcast.
    """
    df = cells.groupBy("cell").agg(F.count("*").alias("df"))
    n = df.filter("cell is null").select("df").scalar()
    idf = df.filter("cell is not null").select(
        F.col("cell").alias("_cell"), F.log((n + 1.0) / (F.col("df") + 1.0)).alias("_idf"))
    rows = cells.join(F.broadcast(idf), F.col("cell") == F.col("_cell"), "left")
    return rows.select(*cells.columns, (F.col("tf") * F.col("_idf")).alias("value"))


def hashed_cells(sentences: DataFrame, keys: Sequence[str] = ("doc_id",),
                 width: int = W.EMBEDDING_WIDTH) -> DataFrame:
    """(keys, sent_id, cell, value): the non-zero cells of TF-IDF vectors of the hashed words."""
    cells = weighted_cells(materialize(counted_cells(sentences, keys, width), "cells"))
    return cells.filter("value <> 0").select(*keys, "sent_id", "cell", "value")


def hashed_embedding(sentences: DataFrame, keys: Sequence[str] = ("doc_id",),
                     width: int = W.EMBEDDING_WIDTH) -> DataFrame:
    """(keys, sent_id, embedding): the same as dense vectors, one per sentence."""
    cells = weighted_cells(materialize(counted_cells(sentences, keys, width), "cells"))
    held = F.map_from_entries(F.collect_list(F.when(
        F.col("cell").isNotNull(), F.struct("cell", "value")))).alias("held")
    rows = cells.groupBy(*keys, "sent_id").agg(held)
    dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.coalesce(
        F.try_element_at("held", c), F.lit(0.0)))
    return rows.select(*keys, "sent_id", dense.alias("embedding"))


# --- embedding tables: groups of any size --------------------------------------

def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays; 0 when either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))

    return rules.ratio(dot, norm(a) * norm(b))


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on keys that may be null; of ``right`` only what is no key stays."""
    on = [F.col(f"left.{k}").eqNullSafe(F.col(f"right.{k}")) for k in keys]
    joined = left.alias("left").join(right.alias("right"), on, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.select("left.*", *[F.col(f"right.{c}") for c in right.columns if c not in keys])


def divided(rows: DataFrame, keys: Sequence[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups of at most ``most`` rows, and the others (None if there are none).  Only the keys
    are read to find out."""
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(*keys)
    if hot.isEmpty():
        return rows, None
    return null_safe(rows, hot, keys, "left_anti"), null_safe(rows, hot, keys, "left_semi")


def adjacent_cosine(table: DataFrame, keys: Sequence[str], order: str, embedding: str,
                    block: int = 100_000) -> DataFrame:
    """(keys, order, adjacent): cosine with the row before it; 0 for the first.

    Groups above ``block`` rows are cut into blocks by place, so a hot group is spread over many
    tasks whatever the values of ``order``; the last row of each block meets the first of the next by a join.
    """
    keys = list(keys)
    rows = table.select(*keys, F.col(order).alias("_at"), F.col(embedding).cast("array<double>").alias("_v"))
    cool, hot = divided(rows, keys, block)
    found = cool.withColumn("_before", F.lag("_v").over(Window.partitionBy(*keys).orderBy("_at")))
    if hot is not None:
        placed = numbered(hot, keys, "_at").withColumn("_block", F.floor(F.col("_pos") / block))
        inside = Window.partitionBy(*keys, "_block").orderBy("_pos")
        placed = placed.withColumn("_before", F.lag("_v").over(inside))
        last = placed.groupBy(*keys, "_block").agg(F.max_by("_v", "_pos").alias("_carried"))
        joined = null_safe(placed, last.withColumn("_block", F.col("_block") + 1), [*keys, "_block"], "left")
        found = found.unionByName(joined.select(*keys, "_at", "_v", F.coalesce("_before", "_carried").alias("_before")))
    return found.select(*keys, F.col("_at").alias(order),
                        F.coalesce(cosine(F.col("_v"), F.col("_before")), F.lit(0.0)).alias("adjacent"))


def previous_similarity(table: DataFrame, keys: Sequence[str], order: str, embedding: str,
                        stripe: int = STRIPE, groups: DataFrame | None = None) -> DataFrame:
    """(keys, order, adjacent, mean_previous, max_previous) over all earlier rows.

    Exact and without emitting pairs; ``order`` must be unique in a group, vectors of null count as zero.
    The mean costs work linear in the rows: a unit vector times the sum of all before it.  The largest cosine
    skips whatever a bound on the sphere rules out, block by block.  A group of up to ``stripe`` rows is
    one task's work; a larger one is cut into stripes by place, see ``striped_similarity``.
    ``max_previous`` is null for the first row of a group.

    ``groups`` says that ``table`` comes group after group, in order, and is a table of the same keys, row by row, that is
    cheaper to count; vectors then stay where they are, unless a group is larger than ``stripe``.
    """
    keys = list(keys)
    rows = table.select(*keys, F.col(order).alias("_order"), F.col(embedding).cast("array<double>").alias("_v"))
    if groups is not None and divided(groups.select(*keys), keys, stripe)[1] is None:
        cool, hot = rows, None
    else:
        cool, hot = divided(rows, keys, stripe)
        cool = cool.repartition(*keys).sortWithinPartitions(*keys, "_order")
    schema = T.StructType([*(rows.schema[k] for k in keys), rows.schema["_order"],
                           *T.StructType.fromDDL("adjacent double, mean_previous double, max_previous double")])
    found = cool.mapInArrow(partial(kernels.whole_groups, keys=keys), schema)
    if hot is not None:
        found = found.unionByName(striped_similarity(hot, keys, stripe))
    return found.withColumnRenamed("_order", order)


def striped_similarity(rows: DataFrame, keys: list[str], stripe: int) -> DataFrame:
    """The same for groups of any size, (keys, _order, _v): only stripes meet.

    1. Narrow rows are numbered and joined with their vectors.  Each stripe, with the last row before it,
       gives its rows' best cosine so far, and a summary: the sum of its unit vectors and the ball round them.
    2. Sums of the stripes before a stripe are added up, dimension by dimension.
    3. A pair of stripes becomes a tile only if their balls allow a cosine above the least of what the
       later one's rows have (``open_tiles``); in a tile each row is held against the ball again.
    """
    numbers = numbered(rows.select(*keys, "_order"), keys, "_order", "_at")
    placed = materialize(null_safe(rows, numbers, [*keys, "_order"]).withColumn(
        "_stripe", F.floor(F.col("_at") / stripe)), "placed")
    group = [*keys, "_stripe"]
    closes = F.col("_at") % stripe == stripe - 1
    carried = placed.filter(closes).withColumn("_stripe", F.col("_stripe") + 1).withColumn("_context", F.lit(True))
    laid = placed.withColumn("_context", F.lit(False)).unionByName(carried)
    key_fields = [rows.schema[k] for k in keys]
    vector = "array<double>"
    schema = T.StructType([*key_fields, *T.StructType.fromDDL("_stripe bigint, _at bigint"), rows.schema["_order"],
                           *T.StructType.fromDDL("_adjacent double, _total double, _best double"),
                           *T.StructType.fromDDL(f"_sum {vector}, _centre {vector}, _angle double, _zero boolean, _least double")])
    own = materialize(laid.repartition(*group).sortWithinPartitions(*group, "_at").mapInArrow(
        partial(kernels.stripes, keys=keys), schema), "stripes")
    stripes = own.filter("_sum is not null").select(*group, "_sum", "_centre", "_angle", "_zero", "_least")
    # All earlier stripes' sums, a row a dimension.
    earlier = Window.partitionBy(*keys, "_i").orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1)
    sums = stripes.select(*group, F.posexplode("_sum").alias("_i", "_x")).withColumn("_x", F.sum("_x").over(earlier))
    offsets = sums.filter("_x is not null").groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_all")).select(
        *group, F.transform("_all", lambda e: e["_x"]).alias("_v"))
    tiles = open_tiles(stripes, keys)
    none = F.lit(None).cast("double")
    asked = null_safe(placed, own.select(*keys, "_at", "_best"), [*keys, "_at"])
    start = [*keys, F.col("_stripe").alias("_i")]
    # Tile (i, -1) is stripe i with the sum of all before it.
    queries = asked.select(*start, F.lit(-1).cast("bigint").alias("_j"), F.lit(1).alias("_kind"), "_at", "_best", "_v").union(
        null_safe(asked.select(*start, "_at", "_best", "_v"), tiles.select(*keys, "_i", "_j"), [*keys, "_i"]).select(
            *keys, "_i", "_j", F.lit(1).alias("_kind"), "_at", "_best", "_v"))
    candidates = null_safe(placed.select(*keys, F.col("_stripe").alias("_j"), "_at", "_v"),
                           tiles.select(*keys, "_j", "_i"), [*keys, "_j"]).select(
        *keys, "_i", "_j", F.lit(0).alias("_kind"), "_at", none.alias("_best"), "_v")
    before = offsets.select(*start, F.lit(-1).cast("bigint").alias("_j"), F.lit(0).alias("_kind"),
                            F.lit(-1).cast("bigint").alias("_at"), none.alias("_best"), "_v")
    tile = [*keys, "_i", "_j"]
    met = queries.union(candidates).union(before).repartition(*tile).sortWithinPartitions(*tile, "_kind", "_at")
    found = met.mapInArrow(partial(kernels.tiles, keys=keys), T.StructType(
        [*key_fields, *T.StructType.fromDDL("_at bigint, _total double, _best double")]))
    whole = own.select(*keys, "_at", "_order", "_adjacent", "_total", "_best").unionByName(
        found, allowMissingColumns=True).groupBy(*keys, "_at").agg(
        F.first("_order", True).alias("_order"), F.max("_adjacent").alias("adjacent"),
        F.sum("_total").alias("_total"), F.max("_best").alias("max_previous"))
    return whole.select(*keys, "_order", "adjacent", rules.ratio(F.col("_total"), F.col("_at")).alias("mean_previous"),
                        "max_previous")


def open_tiles(stripes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _i, _j): pairs of a stripe and an earlier one that may hold a nearer row than some row of
    stripe i has: by the angle between their centres less both radii."""
    late = stripes.select(*keys, F.col("_stripe").alias("_i"), F.col("_centre").alias("_c"), F.col("_angle").alias("_a"),
                          F.col("_zero").alias("_z"), F.col("_least").alias("_l"))
    early = stripes.select(*keys, F.col("_stripe").alias("_j"), "_centre", "_angle", "_zero")
    pairs = null_safe(late, early, keys).filter("_j < _i")
    dot = F.aggregate(F.zip_with("_c", "_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) - F.col("_a") - F.col("_angle")
    bound = F.cos(F.greatest(F.lit(0.0), apart))
    bound = F.when(F.col("_z") | F.col("_zero"), F.greatest(bound, F.lit(0.0))).otherwise(bound)
    return pairs.filter(bound + kernels.SLACK > F.col("_l")).select(*keys, "_i", "_j")
