"""Lexicon files: word norms (CSV) and the rule set (JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainread.functions import wordlists as W


def read_norms(spark: SparkSession, path: str) -> DataFrame:
    """(word, aoa, concreteness, familiarity, imagery): complete rows, words trimmed and
    lower-cased; of several rows for a word the last complete one counts."""
    raw = spark.read.option("header", True).option("nullValue", "NA").csv(path)
    rows = raw.select(
        F.lower(F.trim(W.NORMS_WORD)).alias("word"),
        *[F.col(c).try_cast("double").alias(n) for n, c in W.NORMS_COLUMNS.items()],
        F.struct(F.col("_metadata.file_name").alias("file"),
                 F.monotonically_increasing_id().alias("row")).alias("place")).dropna()
    last = F.max_by(F.struct(*W.NORMS_COLUMNS), "place").alias("last")
    return rows.groupBy("word").agg(last).select("word", "last.*")


def read_ruleset(spark: SparkSession, path: str) -> DataFrame:
    """(category, phrase) of a rule-set file; ``first_person`` is a category too."""
    raw = spark.read.option("multiLine", True).json(path)
    names = raw.schema["connectives"].dataType.fieldNames()
    lists = F.array(
        F.struct(F.lit("first_person").alias("category"), F.col("first_person").alias("phrases")),
        *[F.struct(F.lit(n.removesuffix("_connectives")).alias("category"),
                   F.col(f"connectives.`{n}`").alias("phrases")) for n in names])
    rows = raw.select(F.inline(lists))
    return rows.select("category", F.explode("phrases").alias("phrase"))


def ruleset_words(ruleset: DataFrame) -> DataFrame:
    """(word, rule_categories): the single words of a rule set, each once with its categories."""
    word = F.lower(F.trim("phrase"))
    return ruleset.select(word.alias("word"), "category").filter(
        (F.col("word") != "") & ~F.col("word").contains(" ")).groupBy("word").agg(
        F.array_sort(F.collect_set("category")).alias("rule_categories"))
