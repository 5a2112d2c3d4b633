"""Running views of an attempt log that is still being written."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from answerframe.operators.attempts import KEY, latest_success, usage_sums
from answerframe.sources.attempts import ATTEMPT_SCHEMA


def stream_attempts(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The log as a stream; new files are new attempts. Each row knows its place: file time, file and block."""
    reader = spark.readStream.schema(ATTEMPT_SCHEMA).option("mode", "FAILFAST")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path).select(
        "*",
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def stream_tally(attempts: DataFrame) -> DataFrame:
    """Attempts and tokens per outcome. The state is one row per outcome, so no watermark is needed."""
    outcome = F.coalesce("error", F.lit("OK")).alias("outcome")
    return attempts.groupBy(outcome).agg(F.count("*").alias("attempts"), *usage_sums())


def publish(rows: DataFrame, table: str, version: int) -> None:
    """Put ``rows`` in place of what readers of ``table`` see, at once.

    The rows go to a folder that nothing else uses; a pointer to it is added last. Readers follow the newest pointer, so
    one that reads during a replacement gets the old rows whole, and one that began before is not disturbed.
    A version that is published again, after a failure, only gets a newer pointer.
    """
    spark = rows.sparkSession
    folder = f"rows-{version}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{table}/{folder}")
    pointer = spark.range(1).select(F.lit(version).cast("bigint").alias("version"), F.current_timestamp().alias("at"), F.lit(folder).alias("folder"))
    pointer.write.mode("append").parquet(f"{table}/pointers")


def read_published(spark: SparkSession, table: str) -> DataFrame:
    """The rows published last. Pointers are one row per version; the driver reads the newest."""
    newest = spark.read.parquet(f"{table}/pointers").agg(F.max(F.struct("version", "at", "folder")).alias("p")).first()["p"]
    return spark.read.parquet(f"{table}/{newest['folder']}")


def run_tally(attempts: DataFrame, table: str, checkpoint: str) -> None:
    """Bring the tally at ``table`` up to all files there are now; ``read_published`` reads it."""

    def replace(batch: DataFrame, batch_id: int) -> None:
        publish(batch, table, batch_id)

    (
        stream_tally(attempts)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(replace)
        .start()
        .awaitTermination()
    )


def _placed(batch: DataFrame, position: str) -> DataFrame:
    """Rows with a ``position`` as ``read_attempts`` gives it, from the place of each line where nothing else orders them."""
    if position in batch.columns:
        return batch
    return batch.withColumn(position, F.struct("seq", "file_time", "file", "block", F.monotonically_increasing_id().alias("line")))


def run_latest(
    attempts: DataFrame,
    table: str,
    checkpoint: str,
    keep: Sequence[str] = ("answer",),
    key: Sequence[str] = KEY,
    position: str = "position",
) -> None:
    """Add the latest successes of the new files to the table of latest successes.

    Each micro-batch writes its own folder, at most one row per key, and overwrites it
    when it is run again; nothing already written is rewritten. ``read_latest`` puts the
    folders together. Without a column ``position`` the order is that of ``read_attempts``: ``seq`` where
    the log has one, then file time, file, and place in the file.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        kept = latest_success(_placed(batch, position), keep=[*keep, position], key=key, position=position)
        kept.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    (
        attempts.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(add)
        .start()
        .awaitTermination()
    )


def read_latest(
    spark: SparkSession,
    table: str,
    keep: Sequence[str] = ("answer",),
    key: Sequence[str] = KEY,
    position: str = "position",
) -> DataFrame:
    """The latest success of every key over all micro-batches so far."""
    return latest_success(spark.read.parquet(table), keep=keep, key=key, position=position)


def compact_latest(
    spark: SparkSession,
    table: str,
    target: str,
    keep: Sequence[str] = ("answer",),
    key: Sequence[str] = KEY,
    position: str = "position",
) -> None:
    """Write the table of latest successes anew, one row per key, to another path."""
    latest_success(spark.read.parquet(table), keep=[*keep, position], key=key, position=position).write.mode(
        "overwrite"
    ).parquet(f"{target}/batch=0")
