"""Left lookup of token rows in a word table whose size is checked first."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainread.session import materialize

BROADCAST_BYTES = 64 * 1024 * 1024
HEAD_ROWS = 100_000
SALTS = 1024


@dataclass(frozen=True)
class Words:
    """The words of token rows that lie by ``keys``, none of them null, in ``parts`` partitions."""
    rows: DataFrame  # (keys, the word columns), in any order and partitioning
    keys: Sequence[str]
    parts: int


def fits_broadcast(table: DataFrame, key: str, limit: int = BROADCAST_BYTES) -> bool:
    """True when the table (keys as stored, 64 bytes a row for the rest) is within limit.

    Refuses a table that repeats a key: rows looked up in it would multiply.
    """
    keys = table.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    size, most = keys.agg(F.sum(F.col("_n") * (F.octet_length(key) + 64)), F.max("_n")).first()
    if (most or 0) > 1:
        raise ValueError(f"the lookup table repeats a {key}")
    return (size or 0) <= limit


def lookup(tokens: DataFrame, table: DataFrame, token_key: str, key: str,
           values: Sequence[str], spread: Sequence[str], rank: str | None = None,
           limit: int = BROADCAST_BYTES, words: Words | None = None, uses: DataFrame | None = None) -> DataFrame:
    """``tokens`` with the ``values`` columns of ``table`` where token_key = key.

    ``table`` must be materialized (its size is read) and unique on ``key``.

    * Within ``limit`` bytes it is broadcast.
    * A larger one with ``rank`` (how common a word is) has its most common
      ``HEAD_ROWS`` words broadcast.
    * With ``words`` the token rows stay where they are: each document's other words, once each, meet the
      table, and the answers come to the document's partition as a map, bounded by one text.
    * Without, rows that the common words answer skip the second join: their
      key is null and a salt made from the ``spread`` columns keeps them apart.  What
      is left to shuffle has no hot word.
    * For a larger one without ``rank`` the tokens themselves are counted by key, and the count
      is the rank; or ``uses`` (word, n) has the counts.
    """
    side = table.select(F.col(key).alias("_key"), *[F.col(v).alias(v) for v in values])
    if fits_broadcast(table, key, limit):
        return (tokens.join(F.broadcast(side), tokens[token_key] == side["_key"], "left")
                .drop("_key"))
    if rank is None:
        if uses is None:
            uses = (tokens if words is None else words.rows).groupBy(F.col(token_key).alias("_use")).agg(F.count("*").alias("_uses"))
        else:
            uses = uses.select(F.col("word").alias("_use"), F.col("n").alias("_uses"))
        table = materialize(table.join(uses, F.col(key) == F.col("_use"), "left").select(
            *[F.col(c) for c in table.columns], F.coalesce("_uses", F.lit(0)).alias("_uses")), "lookup")
        rank, side = "_uses", table.select(F.col(key).alias("_key"), *[F.col(v).alias(v) for v in values])
    ordered = table.orderBy(F.desc(rank), F.asc(key)).limit(HEAD_ROWS)
    head = ordered.select(F.col(key).alias("_head"),
                          *[F.col(v).alias(f"_h_{v}") for v in values])
    rows = tokens.join(F.broadcast(head), tokens[token_key] == head["_head"], "left")
    found = F.col("_head").isNotNull()
    if words is not None:
        given = [f"_k{i}" for i in range(len(words.keys))]
        asked = words.rows.select(*[F.col(k).alias(g) for k, g in zip(words.keys, given)], F.col(token_key).alias("_word"))
        asked = asked.join(F.broadcast(head.select("_head")), F.col("_word") == F.col("_head"), "left_anti").distinct()
        answer = F.struct("_word", F.struct(*values).alias("_values"))
        answers = asked.join(side, F.col("_word") == F.col("_key")).select(*given, answer.alias("_one")).repartition(
            words.parts, *given).groupBy(*given).agg(F.map_from_entries(F.collect_list("_one")).alias("_tail"))
        same = [rows[k] == answers[g] for k, g in zip(words.keys, given)]
        rows = rows.join(answers.hint("shuffle_hash"), same, "left")
        rare = F.when(~found, F.try_element_at("_tail", F.col(token_key)))
        return rows.select(*tokens.columns, *[F.when(found, F.col(f"_h_{v}")).otherwise(rare[v]).alias(v) for v in values])
    rows = (rows.withColumn("_miss", F.when(~found, F.col(token_key)))
            .withColumn("_salt", F.when(found, F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
                        .otherwise(F.lit(0)).cast("int")))
    tail = side.withColumn("_salt2", F.lit(0))
    rows = rows.join(tail, (rows["_miss"] == tail["_key"]) & (rows["_salt"] == tail["_salt2"]),
                     "left")
    for v in values:
        rows = rows.withColumn(v, F.coalesce(f"_h_{v}", v))
    return rows.drop("_head", "_miss", "_salt", "_salt2", "_key", *[f"_h_{v}" for v in values])
