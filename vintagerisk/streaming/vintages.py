"""Vintages kept up to date from a folder into which facts land as files.

    files --(epoch, watermark)--> state: newest version per (issuer, field, period, epoch) --(epoch closed)--> Parquet

Filings arrive roughly in the order of their dates.  The event time of a fact is its epoch, the first observation date
that sees it.  While an epoch is open its versions are Spark's state; once the newest epoch seen lies `lateness` days
beyond it, nothing of it is expected any more: its versions are written and leave the state, which so holds the open
epochs only, whatever the length of the history.  Files are read once and versions written once, also when the job is
stopped and started again: the source's and sink's logs are in the checkpoint and the target.

With a code book of tag, form and source (`operators.codes`) state holds numbers of fixed width, which Spark merges in
place; without one every step sorts its rows, since strings do not fit such a buffer.  The versions are then written in
codes too: the book belongs to the target, and `codes.decode` with it gives the words back.

A fact that comes later than promised would be lost without a word; the job stops with an error instead (`LateFacts`).
A feed announces that a day is complete with a heartbeat (`heartbeat`), a row that has a filing date and no issuer.
"""

from __future__ import annotations

import datetime as dt
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vintagerisk.operators.asof import WORD_COLUMNS, epoch_of, newest_version
from vintagerisk.operators.codes import encode
from vintagerisk.sources.storage import FACT_SCHEMA

ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
COUNTED = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"  # looks every key up once more when it is written


class LateFacts(RuntimeError):
    """Facts arrived after their epoch had been closed."""


def fact_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(FACT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def version_stream(facts: DataFrame, dates: list[dt.date], lateness: int, book: DataFrame | None = None) -> DataFrame:
    """Closed versions, one row per (cik, field, period_end, epoch), from a stream of facts.

    Facts without a filing date, or filed after the last date, are seen by no observation and are left out.  Repeated
    facts change nothing.  (cik, field, period_end, filed) is taken for a key, as in the batch form.
    """
    epoch = F.when(F.col("cik").isNull(), F.col("filed")).otherwise(epoch_of(dates))
    facts = facts if book is None else encode(facts, WORD_COLUMNS, book)
    timed = facts.withColumn("closes", epoch.cast("timestamp")).where("closes IS NOT NULL").withWatermark("closes", f"{lateness} days")
    versions = timed.groupBy("cik", "field", "period_end", "closes").agg(*newest_version())
    return versions.withColumn("epoch", F.to_date("closes")).drop("closes")


def update_versions(
    spark: SparkSession, folder: str, target: str, checkpoint: str, dates: list[dt.date], lateness: int, files_per_batch: int = 1000, state: str = ON_DISK,
    book: DataFrame | None = None,
) -> None:
    """Take in all files that landed since the last call, in batches, and write the versions that are closed by then.

    All three folders must be reachable from every executor.  `dates`, `lateness` and `book` belong to the checkpoint: keep
    them, the book with its codes.  A word that the book does not know stops the job.
    """
    with _settings(spark, {PROVIDER: state, COUNTED: "false"}):
        query = (
            version_stream(fact_stream(spark, folder, files_per_batch), dates, lateness, book)
            .writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        late = _rows_too_late(query)
    if late:
        raise LateFacts(f"{late} versions came more than {lateness} days behind the newest epoch; build {target} anew with a longer wait")


def read_versions(spark: SparkSession, target: str) -> DataFrame:
    """The versions written so far, without heartbeats."""
    return spark.read.parquet(target).where("cik IS NOT NULL")


def heartbeat(spark: SparkSession, folder: str, day: dt.date) -> None:
    """Land the notice that every epoch `lateness` days before `day` is complete."""
    spark.createDataFrame([(None, None, None, None, day, None, None, None, None)], FACT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _rows_too_late(query: StreamingQuery) -> int:
    """Wait for the end of a query; how many rows of its batches its state turned away."""
    dropped: dict[int, int] = {}
    done = False
    while not done:
        done = query.awaitTermination(5)
        for progress in query.recentProgress:  # the last hundred batches, far more than five seconds see
            dropped[progress.batchId] = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
    return sum(dropped.values())


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
