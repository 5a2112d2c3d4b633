"""What an attempt log says: successes, usage, failures and work left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from answerframe.constants import ERROR_FIELDS, ERROR_TEXT_LIMIT, USAGE_FIELDS
from answerframe.functions.redact import redact

KEY = ("source_file", "key")


def latest_success(
    attempts: DataFrame, keep: Sequence[str] = ("answer",), key: Sequence[str] = KEY, position: str = "position"
) -> DataFrame:
    """The last success of every key: one aggregate with partial results before the shuffle."""
    value = F.struct(*keep) if len(keep) > 1 else F.col(keep[0])
    last = attempts.filter(F.col("answer").isNotNull()).groupBy(*key).agg(F.max_by(value, position).alias("_v"))
    return last.select(*key, *([F.col(f"_v.{c}") for c in keep] if len(keep) > 1 else [F.col("_v").alias(keep[0])]))


def pending(questions: DataFrame, attempts: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Questions without a logged success. Failed ones are asked again."""
    done = attempts.filter(F.col("answer").isNotNull()).select(*key).distinct()
    return questions.join(done, list(key), "left_anti")


def attach_predictions(
    questions: DataFrame, attempts: DataFrame, name: str = "prediction", key: Sequence[str] = KEY
) -> DataFrame:
    """Every question with the answer of its latest success, or NULL.

    Successes of keys that are not among the questions match nothing, so no extra
    restriction to the selected keys is needed.
    """
    return questions.join(latest_success(attempts, key=key).withColumnRenamed("answer", name), list(key), "left")


def successes_of(attempts: DataFrame, questions: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Logged successes whose key is among the questions."""
    return attempts.filter(F.col("answer").isNotNull()).join(questions.select(*key), list(key), "left_semi")


def usage_sums() -> list[Column]:
    """Token totals over all attempts; an absent usage or field counts 0."""
    return [F.coalesce(F.sum(F.col(f"usage.{field}")), F.lit(0)).alias(field) for field in USAGE_FIELDS]


def usage_totals(attempts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return attempts.groupBy(*by).agg(*usage_sums())


def attempt_summary(attempts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Attempts per outcome: ``OK`` or the error code."""
    outcome = F.coalesce("error", F.lit("OK")).alias("outcome")
    return attempts.groupBy(*by, outcome).agg(F.count("*").alias("attempts"))


def clean_errors(
    failures: DataFrame,
    secrets: Sequence[str] = (),
    status_code: str = "status_code",
    body: str = "body",
    name: str = "error_details",
    limit: int | None = ERROR_TEXT_LIMIT,
) -> DataFrame:
    """Replace status and body (a variant) by what may be logged of a failed call.

    That is the status and four redacted fields, taken from the body's ``error`` object
    where there is one. Fields that are neither text nor whole number nor boolean are
    dropped, as is everything else. The steps are columns of their own, so that each is
    computed once per row.
    """
    inner = F.try_variant_get(body, "$.error", "variant")
    rows = failures.withColumn("_inner", inner).withColumn("_source", F.coalesce("_inner", body))
    rows = rows.withColumns({f"_{f}": F.try_variant_get("_source", f"$.{f}", "variant") for f in ERROR_FIELDS})
    rows = rows.withColumns({f"_{f}_type": F.schema_of_variant(f"_{f}") for f in ERROR_FIELDS})

    def text(field: str) -> Column:
        value, kind = F.col(f"_{field}").cast("string"), F.col(f"_{field}_type")
        return F.when(kind.isin("STRING", "BIGINT"), value).when(kind == "BOOLEAN", F.initcap(value))

    details = F.struct(
        F.col(status_code).cast("int").alias("status_code"),
        *[redact(text(field), secrets, limit).alias(field) for field in ERROR_FIELDS],
    )
    return rows.select(*[c for c in failures.columns if c not in (status_code, body)], details.alias(name))


def config_drift(recorded: DataFrame, wanted: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Fields in which two run manifests differ, one row per run and field.

    Both sides have the same columns. ``on`` names the run; without it each side is one
    manifest. A run that only one side has gives the field ``missing_manifest``. An empty
    result means that the run may go on.
    """
    fields = [c for c in recorded.columns if c not in on]
    keys = list(on)
    if not keys:
        recorded, wanted, keys = recorded.withColumn("_run", F.lit(1)), wanted.withColumn("_run", F.lit(1)), ["_run"]
    left = recorded.select(*keys, F.lit(True).alias("_in_a"), *[F.col(f).alias(f"_a_{f}") for f in fields])
    right = wanted.select(*keys, F.lit(True).alias("_in_b"), *[F.col(f).alias(f"_b_{f}") for f in fields])
    changed = F.filter(
        F.array(*[F.when(~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), F.lit(f)) for f in fields]),
        lambda f: f.isNotNull(),
    )
    one_sided = F.col("_in_a").isNull() | F.col("_in_b").isNull()
    named = F.when(one_sided, F.array(F.lit("missing_manifest"))).otherwise(changed)
    return left.join(right, keys, "full_outer").select(*on, F.explode(named).alias("field"))


def require_same_config(recorded: DataFrame, wanted: DataFrame) -> None:
    """Raise when two one-row manifests differ. Reads at most one row per field."""
    drifted = [row.field for row in config_drift(recorded, wanted).collect()]
    if drifted:
        raise ValueError(f"run settings changed: {', '.join(drifted)}; use a new run folder")
