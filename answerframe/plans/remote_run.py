"""Evaluating a remote model: requests, replies, log, report and export."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from answerframe.functions.answers import answer_labels
from answerframe.functions.requests import payload, request_body, response_schema
from answerframe.operators.attempts import attach_predictions, clean_errors, pending, require_same_config
from answerframe.operators.export import export_predictions
from answerframe.operators.infer import answer_with
from answerframe.operators.replies import parse_replies
from answerframe.operators.score import run_report
from answerframe.session import written
from answerframe.sources.attempts import append_attempts, read_attempts
from answerframe.sources.fingerprint import dataset_fingerprint, fingerprint
from answerframe.sources.questions import read_documents, read_questions, read_stories, require_rows
from answerframe.sources.sinks import write_report, write_stories

REPLY_SCHEMA = (
    "source_file STRING, key STRING, response_id STRING, response_model STRING, "
    "usage STRUCT<prompt_tokens: BIGINT, completion_tokens: BIGINT, total_tokens: BIGINT>, "
    "finish_reason STRING, refusal STRING, content STRING"
)


@dataclass(frozen=True)
class RunConfig:
    """What must not change between two sessions of one run."""

    base_url: str
    model: str
    prompt: str
    input_sha256: str = ""
    temperature: float = 0.0
    max_output_tokens: int = 1200
    format_version: int = 2

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([asdict(self)])


def build_requests(questions: DataFrame, config: RunConfig) -> DataFrame:
    """Payload and request body of every question. No gold answer or other metadata is in them."""
    rows = questions.select(
        "source_file",
        "key",
        "q_type",
        "candidates",
        F.to_json(payload(F.col("story"), F.col("question"), F.col("q_type"), F.col("candidates"))).alias("payload_json"),
    )
    body = request_body(
        F.col("payload_json"),
        response_schema(F.col("q_type"), F.col("candidates")),
        config.model,
        config.prompt,
        config.temperature,
        config.max_output_tokens,
    )
    return rows.withColumn("body", body)


def check_manifest(spark: SparkSession, config: RunConfig, run_folder: str) -> None:
    """Write the manifest of a new run; refuse to go on with another one, or with a log that has none."""
    path = f"{run_folder}/config"
    wanted = config.manifest(spark)
    try:
        recorded = spark.read.schema(wanted.schema).json(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        if not read_attempts(spark, f"{run_folder}/responses").isEmpty():
            raise ValueError("the run folder has attempts but no settings; use a new run folder") from problem
        wanted.coalesce(1).write.json(path)
        return
    require_same_config(recorded, wanted)


def with_input(spark: SparkSession, config: RunConfig, inputs: str | Sequence[str]) -> RunConfig:
    """The settings with the digest of the input files as they are now."""
    digest = dataset_fingerprint(fingerprint(spark, inputs)).first()["input_sha256"]
    return replace(config, input_sha256=digest)


def ask(
    questions: DataFrame,
    config: RunConfig,
    run_folder: str,
    call: Callable[[pd.DataFrame], pd.DataFrame],
    inputs: str | Sequence[str] | None = None,
    secrets: Sequence[str] = (),
    wave: int | None = None,
    per_call: int = 100,
) -> bool:
    """Ask what is still open and add the attempts to the log; whether no call failed.

    A call that raises becomes cleaned failure rows of the log, and its task sends no more; all replies up to then
    are logged. With ``wave``, about so many requests are asked and logged at a time, so that a lost
    task or driver costs no reply of an earlier wave, and after a wave with a failure no further one begins.
    ``inputs`` are the files of the questions: their digest becomes part of the settings, so a
    run refuses to go on with changed ones. ``secrets`` are taken out of error texts.
    """
    spark = questions.sparkSession
    require_rows(questions, "no questions selected")
    if inputs is not None:
        config = with_input(spark, config, inputs)
    check_manifest(spark, config, run_folder)
    log = f"{run_folder}/responses"
    todo = pending(questions, read_attempts(spark, log))
    requests = build_requests(todo, config).select("source_file", "key", "body", "q_type", F.to_json("candidates").alias("_choices"))
    waves = 1
    if wave is not None:
        requests = written(requests, "requests")
        waves = max(1, -(-requests.count() // wave))
    turn = F.pmod(F.xxhash64("source_file", "key"), F.lit(waves))
    for k in range(waves):
        chosen = requests if waves == 1 else requests.filter(turn == k)
        replies = answer_with(chosen, call, REPLY_SCHEMA, per_call, keep=("q_type", "_choices"))
        attempts = written(_attempts(replies, secrets), "attempts")
        append_attempts(attempts, log)
        if not attempts.filter("error_details is not null").isEmpty():
            return False
    return True


def _attempts(replies: DataFrame, secrets: Sequence[str]) -> DataFrame:
    """Parsed replies, and of failed calls the cleaned details."""
    given = replies.withColumn("candidates", F.try_variant_get(F.parse_json("_choices"), "$", "array<variant>"))
    # Secrets are gone before anything is written.
    cleaned = clean_errors(given.withColumn("_body", F.parse_json("failure_body")), secrets, body="_body").drop("failure_body", "_choices")
    parsed = parse_replies(cleaned, keep=("failure", "error_details"))
    failed = F.col("failure").isNotNull()
    return parsed.withColumns({
        "error": F.when(failed, F.col("failure")).otherwise(F.col("error")),
        "error_details": F.when(failed, F.col("error_details")),
    }).drop("failure")


def with_gold_and_predictions(questions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Questions with label arrays ``gold`` and ``prediction``; a null answer is no gold."""
    gold = F.when(F.col("answer_is_null"), F.lit(None)).otherwise(F.col("answer"))
    return attach_predictions(
        questions.select("source_file", "key", "story_index", "question_index", "q_type", gold.alias("_gold")),
        attempts,
        "_prediction",
    ).select(
        "source_file",
        "key",
        "story_index",
        "question_index",
        "q_type",
        F.when(F.col("_gold").isNotNull(), answer_labels(F.col("_gold"))).alias("gold"),
        answer_labels(F.col("_prediction")).alias("prediction"),
        F.col("_prediction").alias("prediction_raw"),
    )


def finish(
    spark: SparkSession, input_path: str, run_folder: str, questions: DataFrame | None = None, layout: str = "document", evaluation: str | None = None
) -> DataFrame:
    """Score the log, write the report and the predictions, and return the report. ``layout`` is that of the input."""
    questions = questions if questions is not None else read_questions(spark, input_path, layout)
    stories = (read_stories if layout == "stories" else read_documents)(spark, input_path)
    attempts = read_attempts(spark, f"{run_folder}/responses")
    joined = written(with_gold_and_predictions(questions, attempts), "joined")
    report = run_report(joined, attempts, evaluation)
    write_report(report, f"{run_folder}/metrics")
    predictions = joined.filter(F.col("prediction_raw").isNotNull()).select(
        "source_file", "story_index", "question_index", F.col("prediction_raw").alias("prediction")
    )
    write_stories(export_predictions(stories, predictions, mode="fresh"), f"{run_folder}/predictions")
    return report
