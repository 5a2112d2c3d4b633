"""Scoring. Each scorer is one shuffle of a few partial rows per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from answerframe.constants import SET_TASKS, SINGLE_LABEL_TASKS
from answerframe.functions.metrics import binary_loss_sum, set_jaccard, softmax_loss
from answerframe.operators.attempts import usage_sums


def question_scores(questions: DataFrame) -> DataFrame:
    """Add ``correct`` and, for the set tasks, ``jaccard``. NULL where gold or prediction is."""
    # Equal sets are exactly those with Jaccard 1, so one set comparison serves both.
    jaccard = set_jaccard(F.col("prediction"), F.col("gold"))
    single = F.col("q_type").isin(*SINGLE_LABEL_TASKS)
    return questions.withColumn("jaccard", F.when(~single, jaccard)).withColumn(
        "correct", F.when(single, F.col("prediction") == F.col("gold")).otherwise(F.col("jaccard") == 1.0)
    )


def score(questions: DataFrame, missing: str, by: Sequence[str] = ()) -> DataFrame:
    """Scores per task (and per ``by``).

    Columns ``q_type``, ``gold`` and ``prediction`` (label arrays). Questions without gold
    are never scored. ``missing="skip"`` scores the predicted ones only; ``"wrong"`` counts
    a missing prediction as wrong with Jaccard 0, even where gold is the empty set, and
    adds ``answered``. There is no default on purpose: the denominators differ.
    """
    if missing not in ("skip", "wrong"):
        raise ValueError("missing must be 'skip' or 'wrong'")
    known = questions.filter(F.col("gold").isNotNull())
    if missing == "skip":
        known = known.filter(F.col("prediction").isNotNull())
    scored = question_scores(known)
    hit = F.when(F.coalesce("correct", F.lit(False)), 1).otherwise(0)
    totals = scored.groupBy(*by, "q_type").agg(
        F.count("*").alias("count"),
        F.count("prediction").alias("answered"),
        F.sum(hit).alias("_hits"),
        F.sum(F.coalesce("jaccard", F.lit(0.0))).alias("_jaccard"),
    )
    single, several = F.col("q_type").isin(*SINGLE_LABEL_TASKS), F.col("q_type").isin(*SET_TASKS)
    return totals.select(
        *by,
        "q_type",
        "count" if missing == "wrong" else F.col("count").cast("double").alias("count"),
        *(["answered"] if missing == "wrong" else []),
        F.when(single, F.col("_hits") / F.col("count")).alias("accuracy"),
        F.when(several, F.col("_hits") / F.col("count")).alias("exact_match"),
        F.when(several, F.col("_jaccard") / F.col("count")).alias("jaccard"),
    )


def primary_score(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over the present tasks of accuracy or exact match; 0 when there is none."""
    return scores.groupBy(*by).agg(
        F.coalesce(F.avg(F.coalesce("accuracy", "exact_match")), F.lit(0.0)).alias("primary_score")
    )


def macro_score(questions: DataFrame, missing: str, dataset: str = "dataset_name") -> DataFrame:
    """Scores per dataset, then their plain mean per task and metric."""
    return score(questions, missing, by=[dataset]).groupBy("q_type").agg(
        F.count("*").alias("datasets"),
        F.avg("accuracy").alias("accuracy"),
        F.avg("exact_match").alias("exact_match"),
        F.avg("jaccard").alias("jaccard"),
    )


def task_metrics_map(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per ``by`` with a map task → metrics. At most one entry per task is gathered."""
    fields = [c for c in ("count", "answered", "accuracy", "exact_match", "jaccard") if c in scores.columns]
    return scores.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("q_type", F.struct(*fields)))).alias("by_task")
    )


def per_file_metrics(questions: DataFrame, missing: str = "skip") -> DataFrame:
    """Map of task metrics for every source file with any gold."""
    return task_metrics_map(score(questions, missing, by=["source_file"]), by=["source_file"])


def run_report(questions: DataFrame, attempts: DataFrame | None = None, evaluation: str | None = None) -> DataFrame:
    """One row: selected, answered, coverage, status, metrics by task and token usage.

    ``questions`` are the selected ones with ``prediction``. Usage is summed over *all*
    attempts, failed ones and those of other questions included. ``evaluation`` says what kind of run it was.
    """
    scored = question_scores(questions)
    has_gold = F.col("gold").isNotNull()
    per_task = scored.groupBy("q_type").agg(
        F.count("*").alias("selected"),
        F.count("prediction").alias("answered"),
        F.count_if(has_gold).alias("count"),
        F.count_if(has_gold & F.col("prediction").isNotNull()).alias("scored"),
        F.count_if(has_gold & F.coalesce("correct", F.lit(False))).alias("hits"),
        F.sum(F.when(has_gold, F.coalesce("jaccard", F.lit(0.0)))).alias("jaccard"),
    )
    single = F.col("q_type").isin(*SINGLE_LABEL_TASKS)
    rate = F.try_divide(F.col("hits"), F.col("count"))
    metrics = F.struct(
        F.col("count").alias("count"),
        F.col("scored").alias("answered"),
        F.when(single, rate).alias("accuracy"),
        F.when(~single, rate).alias("exact_match"),
        F.when(~single, F.try_divide(F.col("jaccard"), F.col("count"))).alias("jaccard"),
    )
    # At most one row per task from here on.
    report = per_task.agg(
        F.coalesce(F.sum("selected"), F.lit(0)).alias("selected_questions"),
        F.coalesce(F.sum("answered"), F.lit(0)).alias("answered_questions"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("count") > 0, F.struct("q_type", metrics.alias("metrics"))))
        ).alias("by_task"),
    )
    columns = [
        F.lit(evaluation).cast("string").alias("evaluation"),
        "selected_questions",
        "answered_questions",
        F.coalesce(F.try_divide("answered_questions", "selected_questions"), F.lit(0.0)).alias("coverage"),
        F.when(F.col("selected_questions") == F.col("answered_questions"), "complete")
        .otherwise("partial")
        .alias("status"),
        F.lit(True).alias("missing_predictions_count_as_incorrect"),
        "by_task",
    ]
    if attempts is not None:
        usage = attempts.agg(*usage_sums()).select(F.struct("*")).scalar()
        columns.append(usage.alias("usage_all_attempts"))
    return report.select(*columns)


def multitask_loss(rows: DataFrame) -> DataFrame:
    """Loss per present task.

    ``rows``: ``q_type``, logits ``yn, co, fr, fb`` and the struct ``labels`` of
    ``encode_labels``. YN and CO: mean cross entropy. FR and FB: masked binary cross
    entropies over the number of unmasked ones (at least 1).
    """
    loss = (
        F.when(F.col("q_type") == "YN", softmax_loss(F.col("yn"), F.col("labels.yn_label")))
        .when(F.col("q_type") == "CO", softmax_loss(F.col("co"), F.col("labels.co_label")))
        .when(F.col("q_type") == "FR", binary_loss_sum(F.col("fr"), F.col("labels.fr_label"), F.col("labels.fr_mask")))
        .when(F.col("q_type") == "FB", binary_loss_sum(F.col("fb"), F.col("labels.fb_label"), F.col("labels.fb_mask")))
    )

    def ones(mask: str):
        return F.aggregate(mask, F.lit(0.0), lambda acc, x: acc + x)

    weight = (
        F.when(F.col("q_type") == "FR", ones("labels.fr_mask"))
        .when(F.col("q_type") == "FB", ones("labels.fb_mask"))
        .otherwise(1.0)
    )
    return rows.groupBy("q_type").agg(
        F.count("*").alias("count"), (F.sum(loss) / F.greatest(F.sum(weight), F.lit(1.0))).alias("loss")
    )


def mean_loss(losses: DataFrame) -> DataFrame:
    """The mean over present tasks."""
    return losses.agg(F.avg("loss").alias("loss"))
