"""The answer contract: choices, validation and normalisation.

Two shapes of answer occur. At the edge an answer is a VARIANT, because ``["1"]``,
``[true]`` and ``[1]`` must be told apart. Inside, after validation or normalisation, it
is an ``ARRAY<STRING>`` of labels: the task says which type a label stands for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from answerframe.constants import CO_LABELS, FR_DK, FR_LABELS, INTEGER_TASKS, TASKS, YN_LABELS

_WHOLE_NUMBER = r"^[\s\x1c-\x1f]*[+-]?[0-9]+(_[0-9]+)*[\s\x1c-\x1f]*$"


def _texts(values) -> Column:
    return F.array(*[F.lit(str(value)) for value in values])


def answer_labels(answer: Column) -> Column:
    """Items of a variant list as text; NULL for anything that is not a list."""
    return F.try_variant_get(answer, "$", "array<string>")


def string_candidates(candidates: Column) -> Column:
    """The candidates that are strings, out of an array of variants."""
    return F.transform(
        F.filter(candidates, lambda c: F.schema_of_variant(c) == "STRING"), lambda c: c.cast("string")
    )


def candidate_texts(candidates: Column) -> Column:
    """Every candidate as text, out of an array of variants; null and booleans as Python writes them."""

    def text(candidate: Column) -> Column:
        plain = candidate.cast("string")
        return (
            F.when(plain.isNull(), "None")
            .when(plain.isin("true", "false") & (F.schema_of_variant(candidate) == "BOOLEAN"), F.initcap(plain))
            .otherwise(plain)
        )

    return F.coalesce(F.transform(candidates, text), F.array().cast("array<string>"))


def answer_choices(q_type: Column, candidates: Column) -> Column:
    """Allowed labels as ``ARRAY<STRING>``; ``candidates`` is an array of strings."""
    return (
        F.when(q_type == "YN", _texts(YN_LABELS))
        .when(q_type == "FR", _texts(FR_LABELS))
        .when(q_type == "FB", candidates)
        .when(q_type == "CO", _texts(CO_LABELS))
    )


def _first_failure(labels: Column, typed: Column | None, q_type: Column, choices: Column) -> Column:
    allowed = F.size(F.array_except(labels, choices)) == 0
    if typed is not None:
        allowed = typed & allowed
    return (
        F.when(~q_type.isin(*TASKS) | q_type.isNull(), "unsupported_task")
        .when(labels.isNull(), "not_a_list")
        .when(~F.coalesce(allowed, F.lit(False)), "invalid_label")
        .when(F.size(F.array_distinct(labels)) < F.size(labels), "duplicate_label")
        .when(q_type.isin("YN", "CO") & (F.size(labels) != 1), "needs_one_label")
        .when((q_type == "FR") & (F.size(labels) == 0), "needs_a_relation")
        .when(
            (q_type == "FR") & F.array_contains(labels, str(FR_DK)) & (F.size(labels) != 1), "dk_not_alone"
        )
    )


def validate_labels(labels: Column, q_type: Column, candidates: Column) -> Column:
    """First broken rule of an ``ARRAY<STRING>`` answer, or NULL when it is valid."""
    return _first_failure(labels, None, q_type, answer_choices(q_type, candidates))


def variant_answer_typed(kind: Column, q_type: Column) -> Column:
    """Whether a variant list's type, as ``schema_of_variant`` names it, is the task's.

    The type of the whole list is compared before any cast: a numeric string, a boolean or
    a fraction is not an integer label. (A list with nulls has the type of its other items;
    the nulls then fail as labels.)
    """
    wanted = F.when(q_type.isin(*INTEGER_TASKS), "ARRAY<BIGINT>").otherwise("ARRAY<STRING>")
    return (kind == "ARRAY<VOID>") | (kind == wanted)


def check_answers(
    rows: DataFrame, answer: str = "answer", labels: str = "labels", reason: str = "reason"
) -> DataFrame:
    """Add the labels of a variant answer and the first rule it breaks (NULL when valid).

    Needs ``q_type`` and ``candidates`` (array of variants). Labels and type are columns of
    their own, so that each is worked out once per row.
    """
    q_type = F.col("q_type")
    typed = rows.withColumn(labels, answer_labels(F.col(answer))).withColumn("_kind", F.schema_of_variant(answer))
    # Candidates matter to FB only, and only that branch looks at their types.
    choices = answer_choices(q_type, string_candidates(F.col("candidates")))
    broken = _first_failure(F.col(labels), variant_answer_typed(F.col("_kind"), q_type), q_type, choices)
    return typed.withColumn(reason, broken).drop("_kind")


def _to_integer_label(item: Column) -> Column:
    kind = F.schema_of_variant(item)
    text = item.cast("string")
    number = (
        F.when(
            (kind == "STRING") & text.rlike(_WHOLE_NUMBER),
            F.regexp_replace(text, r"[\s_\x1c-\x1f]", "").cast("decimal(38,0)"),
        )
        .when(kind == "BOOLEAN", F.when(text == "true", 1).otherwise(0).cast("decimal(38,0)"))
        .when(kind == "BIGINT", text.cast("decimal(38,0)"))
        .when(
            kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"),
            F.when(text.cast("double") < 0, F.ceil(text.cast("double"))).otherwise(F.floor(text.cast("double")))
            .cast("decimal(38,0)"),
        )
    )
    return F.coalesce(number, F.raise_error(F.concat(F.lit("not a whole-number label: "), text)).cast("decimal(38,0)")).cast("string")


def normalize_answer(answer: Column, q_type: Column) -> Column:
    """Labels of an answer in the lenient path.

    A variant null gives no labels, a scalar gives one, and FR/CO items become integers
    (``"7"``, ``true`` and ``3.9`` give 7, 1 and 3; junk raises). SQL NULL (no answer key)
    stays NULL.
    """
    kind = F.schema_of_variant(answer)
    items = F.coalesce(F.try_variant_get(answer, "$", "array<variant>"), F.array(answer))
    integers = q_type.isin(*INTEGER_TASKS)
    return (
        F.when(answer.isNull(), F.lit(None).cast("array<string>"))
        .when(F.is_variant_null(answer), F.array().cast("array<string>"))
        .when(kind == F.when(integers, "ARRAY<BIGINT>").otherwise("ARRAY<STRING>"), answer_labels(answer))
        .when(integers, F.transform(items, _to_integer_label))
        .otherwise(F.transform(items, lambda item: item.cast("string")))
    )


def labels_json(labels: Column, q_type: Column) -> Column:
    """A labels array as typed JSON text: integers for FR and CO, strings otherwise."""
    return F.when(q_type.isin(*INTEGER_TASKS), F.concat(F.lit("["), F.array_join(labels, ","), F.lit("]"))).otherwise(
        F.to_json(labels)
    )
