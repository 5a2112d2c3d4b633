"""Writers for requests, stories and reports. Atomicity is that of Spark's output committer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def write_requests(requests: DataFrame, path: str, body: str = "body") -> None:
    """Request bodies as JSON lines ``{"key": ..., "body": {...}}``."""
    requests.select("source_file", "key", F.parse_json(body).alias("body")).write.mode("overwrite").json(path)


def write_stories(stories: DataFrame, path: str) -> None:
    """Stories as JSON lines, readable by ``read_stories``."""
    stories.select("source_file", "dataset_name", "story_index", "first_question", "item").write.mode(
        "overwrite"
    ).json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines: one file if it is small, as small partitions are merged, and several if it is not."""
    report.hint("rebalance").write.mode("overwrite").json(path)


def document_lines(stories: DataFrame) -> DataFrame:
    """The text lines of one ``{name, data: [...]}`` object per source file.

    Columns ``source_file``, ``line_no`` and ``line``. Lines in order make a valid document, so a
    range-sorted write gives part files that only need to be put one after another; no
    task ever holds a file. A story of several records becomes one story again: its fields come
    first, then the questions of each record on a line of their own, then its end.
    """
    first_story = stories.groupBy("source_file").agg(F.min(F.when(F.col("item").isNotNull(), F.col("story_index"))).alias("_first"))
    fields = F.map_filter(F.col("item").cast("map<string,variant>"), lambda k, v: k != "questions")
    rows = stories.filter(F.col("item").isNotNull()).join(first_story, "source_file").select(
        "source_file", "story_index", "first_question", "item",
        F.try_variant_get("item", "$.questions", "array<variant>").alias("questions"),
        F.when(F.col("story_index") > F.col("_first"), F.lit(",")).otherwise(F.lit("")).alias("comma"),
    )
    nested = rows.filter("questions is not null").withColumn("fields", F.to_json(fields))
    opening = nested.groupBy("source_file", "story_index").agg(F.min_by(F.struct("comma", "fields"), "first_question").alias("s"))
    start = F.regexp_replace("s.fields", r"\}$", "")
    start = F.concat(F.col("s.comma"), start, F.when(F.length(start) > 1, ",").otherwise(""), F.lit('"questions":['))
    listed = F.substring(F.to_json("questions"), 2, 2**31 - 1)
    listed = F.regexp_replace(listed, r"\]$", "")
    body = nested.filter(F.size("questions") > 0).select(
        "source_file", _line("story_index", "first_question", 0), F.when(F.col("first_question") > 0, F.concat(F.lit(","), listed)).otherwise(listed).alias("line")
    )
    plain = rows.filter("questions is null").select("source_file", _line("story_index", "first_question", 0), F.concat("comma", F.to_json("item")).alias("line"))
    edges = stories.groupBy("source_file").agg(F.min("dataset_name").alias("dataset_name"))
    head = F.concat(
        F.lit('{"name":'), F.regexp_extract(F.to_json(F.struct("dataset_name")), r'(?s)^\{"dataset_name":(.*)\}$', 1),
        F.lit(',"data":['),
    )
    last = 2**63 - 1
    return (
        plain.unionByName(body)
        .unionByName(opening.select("source_file", _line("story_index", -1, 0), start.alias("line")))
        .unionByName(opening.select("source_file", _line("story_index", last, 1), F.lit("]}").alias("line")))
        .unionByName(edges.select("source_file", _line(-(2**63), 0, 0), head.alias("line")))
        .unionByName(edges.select("source_file", _line(last, last, 2), F.lit("]}").alias("line")))
    )


def _line(story: str | int, question: str | int, part: int) -> Column:
    at = [(F.col(x) if isinstance(x, str) else F.lit(x)).cast("bigint") for x in (story, question)]
    return F.struct(at[0].alias("story_index"), at[1].alias("first_question"), F.lit(part).alias("part")).alias("line_no")


def write_documents(stories: DataFrame, path: str, partitions: int | None = None, whole: bool = False) -> None:
    """``document_lines`` as text, one folder per source file (named by its stem).

    With ``whole`` every folder holds exactly one file, which is the document and is written by one task.
    Source files need stems of their own.
    """
    lines = document_lines(stories).withColumn(
        "document", F.regexp_replace(F.regexp_extract("source_file", r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")
    )
    # The folder column leads, so that the writer finds its rows in order and sorts no more.
    keys = ["document", "source_file", "line_no"]
    if whole:
        placed = lines.repartition("document")
    else:
        placed = lines.repartitionByRange(partitions, *keys) if partitions else lines.repartitionByRange(*keys)
    placed.sortWithinPartitions(*keys).select("document", "line").write.mode("overwrite").partitionBy(
        "document"
    ).text(path)
