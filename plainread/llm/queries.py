"""The queries of this folder's operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainread.llm import (
    ann,
    byte_bpe,
    covering,
    exact_dedup,
    jaccard_join,
    language_id,
    license_scan,
    merkle,
    packing,
    spelling,
    suffix_dedup,
    toxicity,
    warc,
)
from plainread.llm.common import held_out
from plainread.sources.tables import read_table


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~held_out(F.col("doc_id"))))
    found = language_id.predict(docs.select("doc_id", "text"), *model, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    labels = read_table(spark, sf, "labels").select("doc_id", "toxic")
    train = labels.filter(~held_out(F.col("doc_id")))
    found = toxicity.score(docs, toxicity.fit(docs, train), keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_warc(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages").select("page_id", "url", "html")
    found = warc.read(warc.write(pages, warc.new_archive(pages)))
    return found.select(
        F.col("record_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


def op4_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    both = byte_bpe.decode(byte_bpe.encode(docs))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    found = suffix_dedup.remove_repeats(docs)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans",
                        F.sha2("kept", 256).alias("kept_sha256"))


def op6_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return jaccard_join.near_groups(docs).select("doc_id", "n_shingles", "component_id")


def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return packing.pack(docs).drop("ids")


def op8_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return exact_dedup.copy_groups(docs, keep="largest")


def op9_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return license_scan.scan(docs).drop("spans")


def op10_nearest(spark: SparkSession, sf: str) -> DataFrame:
    table = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    return ann.search(table, F.col("vec_id") % 20 == 0, 20)


def op11_spelling(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return spelling.variants(docs, slips=199)


def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return merkle.proofs(merkle.build(docs, other=merkle.tampered_leaf(docs, 5)))


def op13_simhash(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return covering.near_groups(docs)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_language_id, op2_toxicity, op3_warc, op4_byte_bpe, op5_suffix_dedup, op6_jaccard_join,
            op7_packing, op8_exact_dedup, op9_license_scan, op10_nearest, op11_spelling,
            op12_merkle, op13_simhash]
    return {f.__name__: f for f in made}
