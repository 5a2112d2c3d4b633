"""Reading nested question files and flattening them to one row per question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from answerframe.constants import TASKS
from answerframe.functions.answers import check_answers
from answerframe.functions.text import question_key
from answerframe.sources.documents import read_documents

_NO_ITEMS = "array<variant>"


def read_stories(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per story of JSON-lines files as ``write_stories`` leaves them.

    This layout splits at any line, so it is the one to use for large data.
    """
    return (
        spark.read.schema(
            "source_file STRING, dataset_name STRING, story_index BIGINT, first_question BIGINT, item VARIANT"
        )
        .option("mode", "FAILFAST")
        .json(paths)
    )


def flatten(stories: DataFrame, lenient: bool = False, on_error: str = "fail", validate_gold: bool = True) -> DataFrame:
    """One row per question, with both ordinals, the typed raw answer and the whole raw question.

    Strict mode wants every field the contract names and, with ``validate_gold``, a valid
    answer where one is given. Lenient mode takes missing fields as empty. An unsupported
    task is an error in both. ``on_error="fail"`` raises at the first bad row;
    ``"reject"`` keeps bad rows and says why in ``reject_reason`` (NULL for good rows).
    """
    if on_error not in ("fail", "reject"):
        raise ValueError("on_error must be 'fail' or 'reject'")
    has_data = F.col("has_data") if "has_data" in stories.columns else F.lit(True)
    first = F.col("first_question") if "first_question" in stories.columns else F.lit(0)
    rows = stories.select(
        "source_file",
        "dataset_name",
        "story_index",
        has_data.alias("has_data"),
        F.col("item").isNotNull().alias("has_item"),
        F.coalesce(first, F.lit(0)).cast("bigint").alias("first_question"),
        F.try_variant_get("item", "$.story", "variant").alias("story"),
        F.try_variant_get("item", "$.questions", _NO_ITEMS).alias("questions"),
    ).withColumn("has_questions", F.col("questions").isNotNull())
    # Beside each question go the story's text and what was missing, never the whole story again.
    kept = [c for c in rows.columns if c != "questions"]
    rows = rows.select(*kept, F.posexplode_outer("questions").alias("pos", "raw"))

    def field(name: str) -> Column:
        return F.try_variant_get("raw", f"$.{name}", "variant")

    rows = rows.select(
        "source_file",
        "dataset_name",
        "story_index",
        (F.col("first_question") + F.col("pos")).alias("question_index"),
        "has_data",
        "has_item",
        "has_questions",
        "raw",
        "story",
        field("q_id").alias("q_id"),
        field("q_type").cast("string").alias("q_type"),
        field("question").alias("question"),
        field("candidate_answers").alias("candidate_answers"),
        field("answer").alias("answer"),
    )
    candidates = F.coalesce(F.try_variant_get("candidate_answers", "$", _NO_ITEMS), F.array().cast("array<variant>"))
    rows = rows.withColumn("candidates", candidates)
    no_question = F.col("raw").isNull()

    def missing(name: str) -> Column:
        return F.lit(f"missing_field:{name}")

    if lenient:
        unsupported = ~F.coalesce(F.col("q_type").isin(*TASKS), F.lit(False))
        reason = F.when(~no_question & unsupported, "unsupported_task")
    else:
        reason = (
            F.when(~F.col("has_data"), missing("data"))
            .when(F.col("has_item") & ~F.col("has_questions"), missing("questions"))
            .when(no_question, None)
            .when(F.col("q_type").isNull(), missing("q_type"))
            .when(~F.col("q_type").isin(*TASKS), "unsupported_task")
            .when(F.col("story").isNull(), missing("story"))
            .when(F.col("question").isNull(), missing("question"))
            .when(F.col("candidate_answers").isNull(), missing("candidate_answers"))
        )
        if validate_gold:
            rows = check_answers(rows, "answer", "_labels", "_broken")
            has_gold = F.col("answer").isNotNull() & ~F.is_variant_null("answer")
            reason = reason.when(
                has_gold & F.col("_broken").isNotNull(), F.concat(F.lit("invalid_gold:"), F.col("_broken"))
            )
    rows = rows.withColumn("reject_reason", reason)
    # Stories without questions give no row, unless they are at fault.
    rows = rows.filter(~no_question | F.col("reject_reason").isNotNull())
    if on_error == "fail":
        where = F.concat(
            F.col("source_file"), F.lit(" "), question_key(F.col("story_index"), F.col("question_index")), F.lit(": ")
        )
        rows = rows.filter(
            F.when(F.col("reject_reason").isNull(), True).otherwise(
                F.raise_error(F.concat(where, F.col("reject_reason"))).cast("boolean")
            )
        )
    return rows.select(
        "source_file",
        "dataset_name",
        "story_index",
        "question_index",
        question_key(F.col("story_index"), F.col("question_index")).alias("key"),
        "q_id",
        "q_type",
        F.col("story"),
        F.coalesce(F.col("question").cast("string"), F.lit("")).alias("question"),
        "candidates",
        F.col("answer").isNotNull().alias("has_answer_key"),
        F.coalesce(F.is_variant_null("answer"), F.lit(False)).alias("answer_is_null"),
        "answer",
        "raw",
        *(["reject_reason"] if on_error == "reject" else []),
    )


def read_questions(
    spark: SparkSession,
    paths: str | Sequence[str],
    layout: str = "document",
    lenient: bool = False,
    on_error: str = "fail",
    validate_gold: bool = True,
) -> DataFrame:
    """Read and flatten. ``layout`` is ``document`` (one object per file) or ``stories`` (one per line)."""
    readers = {"document": read_documents, "stories": read_stories}
    return flatten(readers[layout](spark, paths), lenient=lenient, on_error=on_error, validate_gold=validate_gold)


def labelled(questions: DataFrame) -> DataFrame:
    """Questions that have an ``answer`` key, be its value null or not."""
    return questions.filter(F.col("answer").isNotNull())


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """``df`` itself; raises when it is empty (reads at most one row)."""
    if df.isEmpty():
        raise ValueError(message)
    return df
