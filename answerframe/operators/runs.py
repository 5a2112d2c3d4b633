"""Comparing epochs of training runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def best_epoch(epochs: DataFrame, run: Sequence[str] = ("run",)) -> DataFrame:
    """Per run the epoch with the highest ``primary_score``; the earliest one on a tie."""
    best = epochs.groupBy(*run).agg(
        F.min_by("epoch", F.struct((-F.col("primary_score")).alias("s"), "epoch")).alias("epoch"),
        F.max("primary_score").alias("primary_score"),
    )
    return best
