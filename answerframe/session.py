"""Sessions for tests and benchmarks, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Worth setting on any cluster. The JVM does not compile methods over 8,000 bytes, so a wide
# projection fused into one larger method would be interpreted; with this limit Spark
# evaluates such a stage in smaller methods.
ADVISED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}


# Takes the place of ``spark.checkpoint.dir``, which a running session cannot change.
LOCAL_FOLDER = "answerframe.local.folder"


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "answerframe") -> SparkSession:
    """A single-machine session. On a cluster, use the session the cluster gives."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="answerframe-"))
    )
    for name, value in ADVISED.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``.

    The library never makes one up: a session without that setting must have gone through
    ``name_local_folder``, which only single-machine sessions may.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(LOCAL_FOLDER, None)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder.rstrip("/")


def name_local_folder(spark: SparkSession) -> None:
    """Give a single-machine session, as of tests, a folder of its own where none is configured."""
    master = spark.sparkContext.master
    if spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(LOCAL_FOLDER, None):
        return
    if master == "local" or master.startswith("local["):
        spark.conf.set(LOCAL_FOLDER, tempfile.mkdtemp(prefix="answerframe-"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses. Nothing is created yet.

    All paths of an application are under one folder, which may go when the application has ended.
    """
    return f"{shared_folder(spark)}/answerframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage durably (a lost executor re-reads files), fixes the values of
    non-deterministic columns, and lets later passes read only the columns they need. ``options`` are those of the writer.
    """
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
