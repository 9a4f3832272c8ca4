"""From raw documents to token ids: five stages, each over all that the one before it kept.

Each stage is written as Parquet in the shared folder and read again, so a stage starts from files and a
lost executor never reaches back into an earlier stage. Null and empty texts pass every stage: they are
not toxic, have no shingles, hold no secrets, weigh nothing in the mix (size 0, so they end there) and
have no tokens. Different texts under one doc_id are documents of their own, rows equal in id and text are one. Further columns pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import bpe, mixing, neardup, secrets, toxicity
from kerbline.llm.common import prepare_texts, stored, table
from kerbline.llm.queries import rank_file


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity.drop_toxic(docs, table(prepare_texts(spark), sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    prepare_texts(spark)
    return neardup.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays, and n_chars follows the text."""
    prepare_texts(spark)
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0 to 3 rows each."""
    prepare_texts(spark)
    return mixing.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per row, and whether they decode to the text's bytes."""
    prepare_texts(spark)
    keep = tuple(c for c in docs.columns if c not in ("text", "n_chars", "token_ids", "n_tokens", "decodes"))
    encoded = bpe.encode_documents(docs, rank_file(), public_tokenizers.PATTERN, keep=keep, exact="decodes")
    return encoded.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("tokens", encode),
]

#: The classifier, the sampling hash and the byte-level merges are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare_texts(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
