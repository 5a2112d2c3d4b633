"""Evaluating a local model: inputs, labels, split, decoding, scores and overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from answerframe.functions.answers import candidate_texts, labels_json, normalize_answer
from answerframe.functions.decode import decode
from answerframe.functions.labels import encode_labels
from answerframe.functions.text import format_input, normalize_story
from answerframe.operators.export import export_predictions
from answerframe.operators.score import per_file_metrics, primary_score, score
from answerframe.sources.questions import labelled, require_rows


def encoder_inputs(questions: DataFrame) -> DataFrame:
    """Normalised text, candidates, gold labels and label vectors of flattened questions."""
    story = normalize_story(F.col("story"))
    candidates = candidate_texts(F.col("candidates"))
    rows = questions.select(
        "source_file",
        "dataset_name",
        "story_index",
        "question_index",
        "key",
        "q_type",
        candidates.alias("candidates"),
        normalize_answer(F.col("answer"), F.col("q_type")).alias("gold"),
        format_input(story, F.col("question"), candidates).alias("text"),
    )
    return rows.withColumn(
        "labels",
        F.when(F.col("gold").isNotNull(), encode_labels(F.col("q_type"), F.col("gold"), F.col("candidates"))),
    )


def training_inputs(questions: DataFrame) -> DataFrame:
    """The inputs that have an answer key; raises when there are none."""
    return require_rows(encoder_inputs(labelled(questions)), "no training questions with answers")


def predict(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``prediction`` to rows with logits ``yn, co, fr, fb``."""
    return rows.withColumn(
        "prediction",
        decode(
            F.col("q_type"), F.col("yn"), F.col("co"), F.col("fr"), F.col("fb"), F.lit(threshold), F.col("candidates")
        ),
    )


def evaluate(predicted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pooled scores, metrics per file and the primary score of decoded rows."""
    pooled = score(predicted, missing="skip")
    return pooled, per_file_metrics(predicted), primary_score(pooled)


def overlay(stories: DataFrame, predicted: DataFrame) -> DataFrame:
    """Story records in which every prediction replaces the answer field."""

    answers = predicted.select(
        "source_file",
        "story_index",
        "question_index",
        F.parse_json(labels_json(F.col("prediction"), F.col("q_type"))).alias("prediction"),
    )
    return export_predictions(stories, answers, mode="overlay")
