"""Choosing questions and numbering them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from answerframe.session import written

INPUT_ORDER = ("source_file", "story_index", "question_index")


def with_position(questions: DataFrame, order: Sequence[str] = INPUT_ORDER, name: str = "position") -> DataFrame:
    """Number the rows 1..N in ``order`` and add N as ``selected``.

    The rows are range-sorted, which splits any story or file over tasks, and written once
    so that both passes below see the same partitions. The only window runs over one row
    per partition.
    """
    sorted_rows = written(
        questions.orderBy(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_line", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "position",
    )
    counts = sorted_rows.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select(
        "_part",
        (F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(W.partitionBy()).alias("selected"),
    )
    # One row per partition of the sort: bounded by the partition count.
    return (
        sorted_rows.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_line") + 1)
        .drop("_part", "_line", "_before")
    )


def prefix(questions: DataFrame, n: int, order: Sequence[str] = INPUT_ORDER) -> DataFrame:
    """The first ``n`` questions in input order."""
    if n < 1:
        raise ValueError("n must be positive")
    # The same plan for every n: no task gathers the prefix, and a column named ``selected`` stays.
    keys = [f"_by_{i}" for i in range(len(order))]
    wrapped = questions.select(F.struct("*").alias("_row"), *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)])
    return with_position(wrapped, keys, "_position").filter(F.col("_position") <= n).select("_row.*")
