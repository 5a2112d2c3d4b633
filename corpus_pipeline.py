"""From raw documents to a training mix, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept; all
but the last return the columns of documents. ``run`` writes each stage's rows to the shared
folder and reads them back, so a lost executor never goes back beyond a stage.

* language: texts without a letter go; if nothing could be learned, only those
* near_duplicates: one document of each group stays, the one with the smallest id; rows that
  repeat an id become one (the first by text, null last); rows without an id stay
* decontaminate: documents that hold a benchmark item go
* secrets: every secret is replaced by a mask; no document goes
* mix: each document comes as often as the mix takes it, numbered by ``copy``

An empty table gives an empty mix. Columns that documents lack in the contract are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerframe.llm import decontaminate, language, mixing, near_duplicates, secrets
from answerframe.llm.common import table
from answerframe.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MASK = "[SECRET]"

# Rows of documents that a Python worker holds at once. Five stages in one session keep their workers
# for a while, so their batches add up; Spark's own bound in bytes still holds for long texts.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to ``BATCH_ROWS``; a smaller setting stays."""
    now = int(spark.conf.get(_BATCH))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    model = language.train(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return language.identify(docs, model).filter(F.col("lang_pred") != language.UNDETERMINED).select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    kept = near_duplicates.near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), "source", "lang", "n_chars"))
    first = docs.join(kept, "doc_id", "left_semi").withColumn("place", place).filter("place = 1")
    return first.select(*COLUMNS).unionByName(docs.filter("doc_id is null"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    # Rows are told apart by id and text, so that a leak takes no other row along, not even one without an id.
    keyed = docs.select(*COLUMNS).withColumn("row_key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    found = decontaminate.leaks(keyed.select(F.col("row_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(found.select(F.col("doc_id").alias("row_key")).distinct(), "row_key", "left_anti").select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    masked = secrets.scan(docs, secrets.train(docs), mask=MASK)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs.select(*COLUMNS), keep=("text", "lang", "n_chars"))
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.filter("copies > 0").withColumn("copy", copies).select(*COLUMNS, "copy", "size", "source_size", "target")


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("mix", mix_stage),
]

# Learned models and components of a similarity graph are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = spark.conf.get(_BATCH)
    try:
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    finally:
        # The last stage runs no Python, so the caller's setting is back before its rows are made.
        spark.conf.set(_BATCH, before)
    return STAGES[-1][1](spark, docs, sf_dir)
