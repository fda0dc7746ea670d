"""Entities, their candidate links, and what failed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY_SCHEMA = "hospitals array<struct<name: string, state: string, type: string, rank: bigint>>"


def read_entities(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(name, state, type, rank) of files whose objects hold an array ``hospitals``.

    Many objects, one per line, are read in parallel with ``multi_line=False``.
    """
    raw = spark.read.schema(ENTITY_SCHEMA).option("multiLine", multi_line).json(path)
    return raw.select(F.inline("hospitals"))


def first_matching_link(links: DataFrame, entity: str = "entity", link: str = "link",
                        rank: str = "rank", suffix: str = ".pdf") -> DataFrame:
    """(entity, link): per entity the best-ranked of all its links that ends with ``suffix``,
    else null.  One partial aggregate, so an entity with very many links costs a row a task."""
    fits = F.col(link).endswith(F.lit(suffix))
    return links.groupBy(entity).agg(F.min_by(link, F.when(fits, F.col(rank))).alias(link))


def failed_extractions(entities: DataFrame, found: DataFrame, keys: Sequence[str],
                       value: str) -> DataFrame:
    """Entities for which ``found`` has no non-null ``value``."""
    good = found.filter(F.col(value).isNotNull())
    return entities.join(good, list(keys), "left_anti")
