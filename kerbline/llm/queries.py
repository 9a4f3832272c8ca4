"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import bpe, checks, language, licenses, merkle, metric_topk, mixing, neardup, quality, secrets, sharding, toxicity, url_labels, urls, whitening
from kerbline.llm.common import table
from kerbline.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

RANK_FILE = "byte_bpe_50k.tiktoken"


def rank_file() -> bytes:
    return bpe.read_ranks(public_tokenizers.path(RANK_FILE))


@query("op1_secret_scan", sql=checks.SECRETS)
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), into="__all", base_into="__fixed")

    def n(kind: str):
        return F.size(F.filter("__fixed", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.listed(F.col("__fixed")), 256).alias("base_sha256"),
        secrets.listed(F.col("__all")).alias("spans"))


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), into="m")
    return found.select(
        "doc_id", F.size("m").cast("long").alias("n_licenses"), F.array_join(F.array_sort(F.array_distinct("m.license")), ",").alias("licenses"),
        F.coalesce(F.array_max("m.coverage"), F.lit(0.0)).alias("best_coverage"),
        F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"])), ",").alias("spans"))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query("op5_source_mix")
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op6_minhash_dedup", sql=checks.NEAR_DUPLICATES)
def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_histogram_shards")
def op7_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return sharded.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_metric_topk", sql=checks.TOP_INNER_PRODUCTS)
def op8_metric_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_topk.top_inner_products(table(spark, sf_dir, "embeddings"))


@query("op9_bpe_round_trip")
def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), rank_file(), public_tokenizers.PATTERN)


@query("op10_toxicity_chain")
def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), into="p")
    return scored.select(
        "doc_id", *[F.round(F.col(f"p.{c}"), 6).alias(f"p_{c}") for c in (*toxicity.CATEGORIES, toxicity.LAST)],
        (F.col(f"p.{toxicity.LAST}") >= toxicity.THRESHOLD).alias("rejected"))


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_merkle_manifest", sql=checks.MERKLE)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(table(spark, sf_dir, "documents"))


@query("op13_url_filter")
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filter_urls(table(spark, sf_dir, "pages"), url_labels.labelled_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("probability", 6).alias("probability"))
