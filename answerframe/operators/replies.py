"""Turning model replies into logged attempts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from answerframe.constants import INCOMPLETE_REPLY, INVALID_REPLY
from answerframe.functions.answers import check_answers


def with_strict_json(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Add the one JSON value a text holds, as a variant; NULL when it is not exactly one.

    The text must be the only item inside brackets and the only field inside braces: no tail
    after a complete value can close both. An object with a repeated key is rejected too.
    """
    braced = F.try_parse_json(F.concat(F.lit('{"v":'), F.coalesce(text, F.lit("")), F.lit("}")))
    bracketed = F.try_parse_json(F.concat(F.lit("["), F.coalesce(text, F.lit("")), F.lit("]")))
    items = rows.withColumn("_items", F.try_variant_get(bracketed, "$", "array<variant>")).withColumn(
        "_fields", F.try_variant_get(braced, "$", "map<string,variant>")
    )
    single = (F.size("_items") == 1) & (F.size("_fields") == 1)
    return items.withColumn(name, F.when(single, F.get("_items", F.lit(0)))).drop("_items", "_fields")


def parse_replies(replies: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Attempts from raw replies that carry their question's ``q_type`` and ``candidates``; the columns ``keep`` stay.

    A reply that was cut short or refused, and one that does not hold a valid answer with
    a reasoning text, become errors; id, model and usage are kept either way.

    The steps are columns of their own, so that each is computed once per row.
    """
    parsed = with_strict_json(replies, "content", "_value")
    fields = parsed.withColumn("_answer", F.try_variant_get("_value", "$.answer", "variant")).withColumn(
        "_reasoning", F.try_variant_get("_value", "$.reasoning", "variant")
    )
    checked = check_answers(fields, "_answer", "_labels", "_reason")
    cut_short = (F.coalesce("finish_reason", F.lit("")) != "stop") | (F.coalesce("refusal", F.lit("")) != "")
    usable = (
        F.col("_answer").isNotNull()
        & F.coalesce(F.schema_of_variant("_reasoning") == "STRING", F.lit(False))
        & F.col("_reason").isNull()
    )
    judged = checked.withColumn("error", F.when(cut_short, INCOMPLETE_REPLY).when(~usable, INVALID_REPLY))
    good = F.col("error").isNull()
    return judged.select(
        "source_file",
        "key",
        "response_id",
        "response_model",
        "usage",
        F.when(good, F.col("_answer")).alias("answer"),
        F.when(good, F.col("_reasoning").cast("string")).alias("reasoning"),
        "error",
        *keep,
    )
