"""The corpus pipeline: documents to token ids in five stages, each a table in, a table out.

Every stage works on all rows its predecessor kept and all but the last return the columns of documents, with
``n_chars`` brought up to date where a stage changes the text. ORACLE_SQL is None: weak labels, signatures, span
classifiers and token ids are not expressible in SQL; ``tests/llm`` holds the stages against brute force.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.llm import bpe, decontam, neardup, pii, quality
from briefloom.llm.shared import shared_folder, table

ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier keeps."""
    return quality.with_quality(docs, quality.learn(docs)).filter("kept").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id."""
    return neardup.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontam.with_matches(docs, table(spark, sf_dir, "benchmark", ["item_id", "text"]))
    return found.filter(F.size("bench_items") == 0).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and whether the ids decode to the very bytes of the text."""
    ids = bpe.with_ids(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded="__bytes")
    return (ids.withColumn("n_tokens", F.size("ids").cast("long"))
            .withColumn("round_trip", F.col("__bytes") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).drop("__bytes"))


STAGES = [("quality", good_quality), ("near_dedup", one_of_each), ("decontamination", uncontaminated),
          ("pii", without_personal_data), ("tokens", as_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each result is written as Parquet to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES, 1):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{number}-{name}")
        docs = spark.read.parquet(f"{place}/{number}-{name}")
    return docs
