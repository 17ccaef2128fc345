"""Tables in and out, and reliable lineage cuts for iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FACT_SCHEMA = T.StructType(
    [
        T.StructField("cik", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("period_end", T.DateType()),
        T.StructField("filed", T.DateType()),
        T.StructField("form", T.StringType()),
        T.StructField("fiscal_year", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("tag", T.StringType()),
    ]
)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in `spark.checkpoint.dir`."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoints(spark: SparkSession) -> None:
    """Reliable checkpoints go to the shared folder unless the session already has a place for them."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so an iterative job survives lost executors."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def write_facts(facts: DataFrame, path: str) -> None:
    """Facts land as Parquet laid out by field, so a snapshot reads only the fields it needs."""
    (
        facts.select(*FACT_SCHEMA.fieldNames())
        .write.mode("overwrite").partitionBy("field").parquet(path)
    )


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACT_SCHEMA).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_facts_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV exchange form: the schema is pinned so a zero-padded CIK stays a string."""
    return spark.read.schema(FACT_SCHEMA).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
