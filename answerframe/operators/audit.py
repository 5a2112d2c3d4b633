"""Profiles and audits of question sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from answerframe.constants import PAYLOAD_FIELDS


def count_by_task(questions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return questions.groupBy(*by, "q_type").agg(F.count("*").alias("questions"))


def profile(questions: DataFrame, dataset: str = "dataset_name") -> DataFrame:
    """Per dataset: stories, questions, and questions per task.

    Stories are counted by grouping on them first, so a story with very many questions
    is combined before the shuffle.
    """
    tasks = ("YN", "FR", "FB", "CO")
    per_story = questions.groupBy(dataset, "source_file", "story_index").agg(
        F.count("*").alias("questions"),
        *[F.count_if(F.col("q_type") == t).alias(t.lower()) for t in tasks],
        F.count("gold").alias("labelled"),
    )
    return per_story.groupBy(dataset).agg(
        F.count("*").alias("stories"),
        *[F.sum(c).alias(c) for c in ("questions", *[t.lower() for t in tasks], "labelled")],
    )


def label_audit(questions: DataFrame, dataset: str = "dataset_name") -> DataFrame:
    """How often each label is in a gold answer, per dataset and task; ``(empty)`` for none."""
    labels = F.when(F.size("gold") == 0, F.array(F.lit("(empty)"))).otherwise(F.col("gold"))
    return (
        questions.filter(F.col("gold").isNotNull())
        .select(dataset, "q_type", F.explode(labels).alias("label"))
        .groupBy(dataset, "q_type", "label")
        .agg(F.count("*").alias("questions"))
    )


def task_rollup(questions: DataFrame, dataset: str = "dataset_name") -> DataFrame:
    """Questions per dataset and task with subtotals; ``level`` is 0, 1 (dataset) or 3 (all)."""
    return questions.rollup(dataset, "q_type").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("questions")
    )


def leak_audit(requests: DataFrame, payload_json: str = "payload_json", by: Sequence[str] = ()) -> DataFrame:
    """Payload fields that should not be there, with the number of requests that have them.

    An empty result means that only the four allowed fields leave.
    """
    extra = F.array_except(
        F.json_object_keys(F.col(payload_json)), F.array(*[F.lit(f) for f in PAYLOAD_FIELDS])
    )
    return (
        requests.select(*by, F.explode(extra).alias("field")).groupBy(*by, "field").agg(F.count("*").alias("requests"))
    )


def word_count(text: Column) -> Column:
    """White-space words: the stand-in where no tokenizer is given."""
    return F.size(F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != ""))


def truncation_audit(
    questions: DataFrame,
    max_length: int = 384,
    special_tokens: int = 2,
    tokens: Callable[[Column], Column] = word_count,
    before_question: str = "before_question",
    text: str = "text",
    by: Sequence[str] = ("q_type",),
) -> DataFrame:
    """Inputs longer than ``max_length`` tokens, and those whose cut falls before the question ends.

    ``before_question`` is the text in front of the question, so that the cut reaches the
    question when story and question together pass the limit. ``tokens`` may be a pandas UDF.
    """
    room = max_length - special_tokens
    return questions.groupBy(*by).agg(
        F.count("*").alias("questions"),
        F.count_if(tokens(F.col(text)) > room).alias("truncated"),
        F.count_if(tokens(F.col(before_question)) >= room).alias("question_lost"),
        F.max(tokens(F.col(text))).cast("bigint").alias("longest"),
    )
