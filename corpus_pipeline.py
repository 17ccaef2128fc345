"""A corpus pipeline of five stages over `documents`: each reads what the stage before kept, as Parquet.

Language: documents without letters, or for whose language nothing speaks (a score under 0.3), go. Exact and near
duplicates: one document of each group stays. Secrets: documents in which a rule finds something go. Packing: the pieces
of the remaining documents and their places in sequences of 2,048 tokens.

Nulls, empty tables and further columns: as each operator's module states; all stages but the last return every column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagerisk.llm import block_naming, jaccard_join, language_id, packing, secret_scan
from vintagerisk.llm.frames import land, scratch
from vintagerisk.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    return language_id.identified(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return block_naming.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.without_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.without_secrets(docs, secret_scan.create_ledger(spark, scratch(spark, "ledger")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # smaller memories than the operator's own: the executors still hold what the stages before took
    return packing.packed_documents(docs, vocabulary("word_bpe_49k.json"), end_id=0, known=150_000, slice_bytes=1 << 20)


STAGES = [("language", language), ("exact", exact), ("near", near), ("secrets", secrets), ("pack", pack)]

# a fitted model, shingle similarity and best-fit packing are not SQL; the tests hold every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
