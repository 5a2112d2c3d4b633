"""Models: batch scoring, linear heads, remote calls and pooling."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from answerframe.constants import CO_LABELS, FB_LABELS, FR_LABELS, YN_LABELS
from answerframe.session import written

HEAD_SIZES = {"yn": len(YN_LABELS), "co": len(CO_LABELS), "fr": len(FR_LABELS), "fb": len(FB_LABELS)}


def score_with_model(
    rows: DataFrame, make_predict: Callable, features: str, width: int, batch_size: int = 1024
) -> DataFrame:
    """Add the four logit vectors of a caller's model.

    ``make_predict()`` runs once per Python worker, loads the model and returns a function
    from a float array of shape (batch, ``width``) to a dict of four arrays.
    """
    returns = StructType([StructField(name, ArrayType(FloatType())) for name in HEAD_SIZES])
    heads = predict_batch_udf(make_predict, return_type=returns, batch_size=batch_size, input_tensor_shapes=[[width]])
    scored = rows.withColumn("_heads", heads(F.col(features)))
    return scored.select("*", *[F.col(f"_heads.{name}").alias(name) for name in HEAD_SIZES]).drop("_heads")


FAILURE_SCHEMA = "failure STRING, status_code INT, failure_body STRING"


def answer_with(
    requests: DataFrame,
    call: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    per_call: int = 100,
    keep: Sequence[str] = (),
    key: Sequence[str] = ("source_file", "key"),
) -> DataFrame:
    """Replies of a caller's transport to requests, ``per_call`` at a time, and the failure of one that raises.

    ``call`` gets a pandas frame of requests and returns one of replies in ``schema``, which holds ``key``. If it
    raises, each of its requests becomes a row with the columns of ``FAILURE_SCHEMA`` instead of a reply, and the
    requests that the task has not sent yet are left: what was answered so far is kept, and nothing
    more is paid for. Requests without a reply give no row. The columns ``keep`` (plain types) go from a request to its
    reply without a join. Write the result before using it twice: a transport may answer differently each time.
    """
    sent = [c for c in requests.columns if c not in keep]
    kept = ", ".join(f"`{c}` {requests.schema[c].dataType.simpleString()}" for c in keep)
    whole = ", ".join(filter(None, [schema, FAILURE_SCHEMA, kept]))
    names = [f.name for f in StructType.fromDDL(whole).fields]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), per_call):
                part = frame.iloc[start : start + per_call].reset_index(drop=True)
                failed = False
                try:
                    replies = call(part[sent])
                except Exception as problem:  # noqa: BLE001
                    failed = True
                    replies = part[list(key)].assign(**_failure(problem))
                replies = replies.merge(part[[*key, *keep]], on=list(key), how="inner") if len(replies) else replies
                yield replies.reindex(columns=names).astype(object).where(lambda x: x.notna(), None)
                if failed:
                    return

    return requests.mapInPandas(batches, whole)


def _failure(problem: Exception) -> dict:
    """Name, status and body of an exception; its text where it has no body."""
    status, body = getattr(problem, "status_code", None), getattr(problem, "body", None)
    if not isinstance(body, dict):
        body = {"message": str(problem)}
    return {
        "failure": type(problem).__name__,
        "status_code": status if isinstance(status, int) else None,
        "failure_body": json.dumps(body, default=str),
    }


def masked_mean_pool(hidden: str, mask: str):
    """Mean of the unmasked token vectors of one row; zeros when all are masked.

    ``hidden`` is an array of float arrays (tokens by dimensions), ``mask`` an array of
    0 and 1. No shuffle.
    """
    pairs = F.arrays_zip(F.col(hidden).alias("h"), F.col(mask).alias("m"))
    zeros = F.transform(F.element_at(hidden, 1), lambda x: F.lit(0.0))
    summed = F.aggregate(
        pairs, zeros, lambda acc, p: F.zip_with(acc, p["h"], lambda a, x: a + x.cast("double") * p["m"])
    )
    weight = F.greatest(F.aggregate(F.col(mask), F.lit(0.0), lambda acc, m: acc + m), F.lit(1.0))
    return F.transform(summed, lambda x: x / weight)


def masked_mean_pool_tokens(
    tokens: DataFrame, key: Sequence[str], vector: str = "vector", mask: str = "mask"
) -> DataFrame:
    """The same for one token per row: ``key``, ``dim`` (1-based) and ``value``.

    Dimensions are summed as plain numbers with partial sums before the shuffle, so a key
    with very many tokens is no burden on any task.
    """
    cells = tokens.select(*key, mask, F.posexplode(vector).alias("_dim", "_x"))
    return cells.groupBy(*key, (F.col("_dim") + 1).alias("dim")).agg(
        (F.sum(F.col("_x").cast("double") * F.col(mask)) / F.greatest(F.sum(F.col(mask)), F.lit(1))).alias("value")
    )


def fit_heads(
    rows: DataFrame, features: str = "features", max_iter: int = 20, reg: float = 0.01, parallelism: int = 4
) -> dict:
    """Linear heads on given vectors: multinomial for YN and CO, one binary model per FR and FB label.

    ``rows``: ``q_type``, an array column ``features`` and the struct ``labels`` of
    ``encode_labels``. FB labels are learnt from the questions whose mask is set. A head
    with no rows gets no model. The training set is written once; up to ``parallelism``
    heads are fitted at a time, each as Spark jobs over the whole of its rows.
    """
    data = written(
        rows.select("q_type", "labels", F.col(features).cast("array<double>").alias("features")), "training"
    ).withColumn("features", array_to_vector("features"))
    tasks = {
        "yn": (F.col("q_type") == "YN", F.col("labels.yn_label"), "multinomial"),
        "co": (F.col("q_type") == "CO", F.col("labels.co_label"), "multinomial"),
    }
    for name, size in (("fr", len(FR_LABELS)), ("fb", len(FB_LABELS))):
        for i in range(size):
            open_rows = (F.col("q_type") == name.upper()) & (F.get(f"labels.{name}_mask", F.lit(i)) == 1.0)
            tasks[f"{name}{i}"] = (open_rows, F.get(f"labels.{name}_label", F.lit(i)), "binomial")

    def fit(task):
        chosen, label, family = task
        train = data.filter(chosen).select("features", label.cast("double").alias("label"))
        if train.isEmpty():
            return None
        return LogisticRegression(family=family, maxIter=max_iter, regParam=reg).fit(train)

    with ThreadPoolExecutor(parallelism) as pool:
        return dict(zip(tasks, pool.map(inheritable_thread_target(rows.sparkSession)(fit), tasks.values())))


def apply_heads(rows: DataFrame, models: dict, features: str = "features") -> DataFrame:
    """Add logits ``yn, co, fr, fb`` of fitted heads, as JVM expressions over the coefficients.

    A label the heads never saw gets a very low logit.
    """
    vector = F.col(features).cast("array<double>")

    def dot(weights, intercept):
        products = F.zip_with(vector, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w)
        return F.aggregate(products, F.lit(float(intercept)), lambda acc, x: acc + x)

    never = F.lit(-1e6)

    def multinomial(name: str):
        model = models.get(name)
        rows_of = model.coefficientMatrix.toArray() if model is not None else []
        offsets = model.interceptVector.toArray() if model is not None else []
        return F.array(
            *[dot(rows_of[i], offsets[i]) if i < len(rows_of) else never for i in range(HEAD_SIZES[name])]
        )

    def binary(name: str, i: int):
        model = models.get(f"{name}{i}")
        return never if model is None else dot(model.coefficients.toArray(), model.intercept)

    return rows.select(
        "*",
        multinomial("yn").alias("yn"),
        multinomial("co").alias("co"),
        F.array(*[binary("fr", i) for i in range(HEAD_SIZES["fr"])]).alias("fr"),
        F.array(*[binary("fb", i) for i in range(HEAD_SIZES["fb"])]).alias("fb"),
    )
