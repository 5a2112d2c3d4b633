"""Putting predictions back into the nested source structure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# A story with more questions than this is written as several records; see ``group_questions``.
QUESTIONS_PER_RECORD = 10_000


def group_questions(rows: DataFrame, per_record: int = QUESTIONS_PER_RECORD) -> DataFrame:
    """Nest questions into their stories.

    ``rows``: ``source_file, dataset_name, story_index, question_index, raw_json`` (JSON text
    of the question) and ``item`` (variant: the story without its questions; set in at least
    one row of every record, so that a long story need not travel with each question).
    Rows with a NULL ``question_index`` keep a story without questions.

    A story becomes one record, or, past ``per_record`` questions, one record per block of
    question ordinals, each with its ``first_question``; readers add that offset. So no
    task gathers more than ``per_record`` questions, and none is left out.
    """
    block = F.coalesce(F.floor(F.col("question_index") / per_record), F.lit(0))
    grouped = rows.groupBy("source_file", "dataset_name", "story_index", block.alias("_block")).agg(
        F.first("item", ignorenulls=True).alias("item"),
        F.sort_array(F.collect_list(F.when(F.col("raw_json").isNotNull(), F.struct("question_index", "raw_json")))).alias(
            "qs"
        ),
    )
    questions = F.parse_json(
        F.concat(F.lit("["), F.array_join(F.transform("qs", lambda q: q["raw_json"]), ","), F.lit("]"))
    )
    item = F.to_variant_object(F.map_concat(_without(F.col("item"), "questions"), F.create_map(F.lit("questions"), questions)))
    return grouped.select(
        "source_file",
        "dataset_name",
        "story_index",
        F.coalesce(F.try_element_at("qs", F.lit(1))["question_index"], F.lit(0)).alias("first_question"),
        item.alias("item"),
    )


def _without(value: Column, field: str) -> Column:
    """The fields of a variant object but one, as a map."""
    return F.map_filter(value.cast("map<string,variant>"), lambda k, v: k != field)


def _with_answer(raw: Column, answer: Column, overlay: bool) -> Column:
    """JSON text of a question with its answer set, replaced or taken out."""
    bare = _without(raw, "answer")
    filled = F.map_concat(bare, F.create_map(F.lit("answer"), answer))
    return F.to_json(F.when(answer.isNotNull(), filled).otherwise(raw.cast("map<string,variant>") if overlay else bare))


def export_predictions(
    stories: DataFrame,
    predictions: DataFrame,
    mode: str,
    key: Sequence[str] = ("source_file", "story_index", "question_index"),
    per_record: int = QUESTIONS_PER_RECORD,
) -> DataFrame:
    """Story records with predictions in the ``answer`` fields.

    ``stories`` come from ``read_documents`` or ``read_stories``; ``predictions`` hold the
    ordinals and ``prediction`` (variant), at most one row per question. ``mode="fresh"``
    takes every given answer out first, so an unanswered question has none;
    ``"overlay"`` leaves what is not predicted as it was. Everything else is kept.
    """
    if mode not in ("fresh", "overlay"):
        raise ValueError("mode must be 'fresh' or 'overlay'")
    offset = F.coalesce("first_question", F.lit(0)) if "first_question" in stories.columns else F.lit(0)
    rows = stories.select(
        "source_file",
        "dataset_name",
        "story_index",
        offset.cast("bigint").alias("_offset"),
        F.to_variant_object(_without(F.col("item"), "questions")).alias("item"),
        F.try_variant_get("item", "$.questions", "array<variant>").alias("_questions"),
    )
    # The questions are taken out first, so that no question carries all of its story's questions along.
    kept = [c for c in rows.columns if c != "_questions"]
    rows = rows.select(*kept, F.posexplode_outer("_questions").alias("_pos", "raw")).withColumn(
        "question_index", F.col("_offset") + F.col("_pos")
    )
    opens_record = F.col("_pos").isNull() | (F.col("_pos") == 0) | (F.col("question_index") % per_record == 0)
    filled = rows.join(predictions.select(*key, "prediction"), list(key), "left").select(
        "source_file",
        "dataset_name",
        "story_index",
        "question_index",
        F.when(opens_record, F.col("item")).alias("item"),
        F.when(
            F.col("raw").isNotNull(), _with_answer(F.col("raw"), F.col("prediction"), mode == "overlay")
        ).alias("raw_json"),
    )
    return group_questions(filled, per_record)
