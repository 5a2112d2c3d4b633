"""The append-only attempt log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F

ATTEMPT_SCHEMA = (
    "key STRING, response_id STRING, response_model STRING, "
    "usage STRUCT<prompt_tokens: BIGINT, completion_tokens: BIGINT, total_tokens: BIGINT>, "
    "answer VARIANT, reasoning STRING, error STRING, "
    "error_details STRUCT<status_code: INT, message: STRING, code: STRING, param: STRING, type: STRING>, "
    "source_file STRING, seq BIGINT"
)


def _exists(reader: DataFrameReader, path: str) -> bool:
    try:
        reader.json(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def read_attempts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All attempts with a ``position`` that orders them.

    Blank lines are skipped, a bad line raises, and a path that does not exist yet is empty.
    The order is: the caller's ``seq`` where the log has one, then file time, file, place
    in the file.
    """
    reader = spark.read.schema(ATTEMPT_SCHEMA).option("mode", "FAILFAST")
    present = [path for path in ([paths] if isinstance(paths, str) else paths) if _exists(reader, path)]
    if not present:
        lines = spark.createDataFrame([], ATTEMPT_SCHEMA)
        return lines.withColumn("position", _position_of_nothing())
    lines = reader.json(present)
    return lines.select(
        "*",
        F.struct(
            F.col("seq"),
            F.col("_metadata.file_modification_time").alias("file_time"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("position"),
    )


def _position_of_nothing():
    return F.lit(None).cast("struct<seq: bigint, file_time: timestamp, file: string, block: bigint, line: bigint>")


def append_attempts(attempts: DataFrame, path: str) -> None:
    """Add attempts to the log, one JSON line each. Fields that are not set are left out."""
    known = [name for name in attempts.columns if name != "position"]
    attempts.select(*known).write.mode("append").json(path)
