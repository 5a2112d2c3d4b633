"""Reading ``{name, data: [...]}`` documents of any size in many tasks.

Spark's text source cuts a file into blocks of bytes at any ``}``, from whatever store it reads. What a block
means depends on what stands before it: whether it starts inside a text, and how deep. So a first
pass gives for each block where it ends from either start, one row a block; sums over these rows give every
block its true start; and a second pass cuts the elements of ``data`` out. Elements that lie in
one block, which are nearly all, are never shuffled; the pieces of others are put together.

A row holds one element at most, so only an element, not a file, has to fit into a task and a variant.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from answerframe.session import written

# Outside texts: a whole text, a text that does not end here, or one of the marks of structure.
_MARKS = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\Z)|[\[\]{},:]', re.DOTALL)
_TEXT_END = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
_STEP = {"{": 1, "[": 1, "}": -1, "]": -1}


def _closed(text: str) -> bool:
    """Whether a matched text has its last quote."""
    return len(text) > 1 and text[-1] == '"' and (len(text) - len(text[:-1].rstrip("\\"))) % 2 == 1


def _after(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether a text is open after a piece, and by how much it goes deeper."""
    at, depth = 0, 0
    if inside:
        end = _TEXT_END.match(piece)
        if end is None:
            return True, 0
        at = end.end()
    for mark in _MARKS.finditer(piece, at):
        found = mark.group()
        if found[0] != '"':
            depth += _STEP.get(found, 0)
        elif not _closed(found):
            return True, depth
    return False, depth


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str, dict]]:
    """Rows as ``(file, block)``, the piece with its closing bracket, and the other columns."""
    for batch in batches:
        for row in batch.to_pylist():
            yield (row["source_file"], row["block"]), row["value"] + "}", row


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, from either start: whether a text is open at its end, and the change of depth."""
    sums: dict[tuple, list] = {}
    for key, piece, _ in _blocks(batches):
        s = sums.setdefault(key, [False, 0, True, 0])
        for k in (0, 2):
            s[k], by = _after(piece, s[k])
            s[k + 1] += by
    if sums:
        columns = [[k[0] for k in sums], [k[1] for k in sums], *([s[i] for s in sums.values()] for i in range(4))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), *[pa.bool_(), pa.int64()] * 2], strict=True)],
            ["source_file", "block", "open_0", "deeper_0", "open_1", "deeper_1"],
        )


_PIECES = "source_file string, block long, region int, key string, local long, seq long, opens boolean, closes boolean, text string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of values under ``name`` and of elements under ``data``.

    ``region`` counts the top-level keys since the block's start; region 0 is what the block starts in, of a
    ``key`` that only the blocks before know. ``local`` counts the commas of the array so far. A
    row without text tells how many there were when the region ended.
    """
    out: list[tuple] = []
    state = None

    def emit() -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
        arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["source_file", "block", "region", "key", "local", "seq", "opens", "closes", "text"])

    for where, piece, row in _blocks(batches):
        if state is None or state.where != where:
            if state is not None:
                out.extend(state.end())
            state = _Cutter(where, row["inside"], row["depth"])
        out.extend(state.feed(piece))
        if len(out) >= 2000:
            yield emit()
            out = []
    if state is not None:
        out.extend(state.end())
    if out:
        yield emit()


class _Cutter:
    """Cuts the pieces of one block, from a known start."""

    def __init__(self, where: tuple, inside: bool, depth: int):
        self.where, self.inside, self.depth = where, inside, depth
        self.region, self.key, self.local, self.seq = 0, None, 0, 0
        self.opens, self.done, self.held, self.last_text = False, False, [], None

    def _wanted(self) -> bool:
        """Whether characters here belong to a value that may be asked for."""
        return not self.done and (self.key in (None, "data") and self.depth >= 2 or self.key == "name" and self.depth >= 1)

    def _piece(self, closes: bool) -> list[tuple]:
        text, self.held = "".join(self.held), []
        self.seq += 1
        found = (*self.where, self.region, self.key, self.local, self.seq, self.opens, closes, text)
        self.opens = True
        return [found] if text.strip() else []

    def _leave(self) -> list[tuple]:
        """The region ends: what is left of its value, and its number of commas. The next one begins."""
        found = self._piece(True) if self.held else []
        found.append((*self.where, self.region, self.key, self.local, self.seq, True, True, None))
        self.region, self.key, self.local, self.opens, self.done = self.region + 1, "", 0, True, False
        return found

    def feed(self, piece: str) -> list[tuple]:
        found: list[tuple] = []
        at = start = 0
        if self.inside:
            end = _TEXT_END.match(piece)
            if end is None:
                if self._wanted():
                    self.held.append(piece)
                return found
            at, self.inside = end.end(), False

        def hold(upto: int) -> None:
            if self._wanted():
                self.held.append(piece[start:upto])

        for mark in _MARKS.finditer(piece, at):
            text = mark.group()
            if text[0] == '"':
                self.last_text = text
                self.inside = not _closed(text)
                continue
            if text == ":" and self.depth == 1:
                # The text before was a key: what was held up to now is not part of a value.
                self.held = []
                found += self._leave()
                self.key, start = (self.last_text or "")[1:-1], mark.end()
            elif text == "," and self.depth == 1 and self.key == "name" and not self.done:
                hold(mark.start())
                found += self._piece(True)
                self.done = True
            elif text == "," and self.depth == 2 and self.key in (None, "data"):
                hold(mark.start())
                found += self._piece(True)
                self.local, start = self.local + 1, mark.end()
            elif text in _STEP:
                if text in "[{":
                    if self.depth == 1 and self.key == "data" and text == "[":
                        self.opens, start = True, mark.end()
                    elif self.depth == 1 and self.key == "data":
                        self.key = ""
                    self.depth += 1
                    continue
                if self.depth == 2 and self.key in (None, "data"):
                    hold(mark.start())
                    found += self._piece(True)
                    start = mark.end()
                elif self.depth == 1:
                    hold(mark.start())
                    found += self._leave()
                    start = mark.end()
                self.depth -= 1
        if self._wanted():
            self.held.append(piece[start:])
        return found

    def end(self) -> list[tuple]:
        """What is open at the end of the block, and the commas of the last region."""
        open_piece = self._piece(False) if self.held else []
        return [*open_piece, (*self.where, self.region, self.key, self.local, self.seq, False, False, None)]


def _starts(sums: DataFrame) -> DataFrame:
    """``source_file, block, inside, depth`` at the start of each block, and of a last one behind the file.

    Whether a text is open after some blocks is a map of two states, and so is that after all blocks before:
    the last block that ends alike from either start settles it, and blocks after it that swap
    the two are counted.
    """
    ordered = W.partitionBy("source_file").orderBy("block")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    settles = F.col("open_0") == F.col("open_1")
    swaps = F.when(~settles & F.col("open_0"), 1).otherwise(0)
    known = sums.withColumn("swaps", F.sum(swaps).over(ordered)).withColumn("settled", F.when(settles, F.struct("open_0", "swaps")))
    last = F.last("settled", ignorenulls=True).over(before)
    swapped = F.coalesce(F.lag("swaps").over(ordered), F.lit(0)) - F.coalesce(last["swaps"], F.lit(0))
    inside = F.coalesce(last["open_0"], F.lit(False)) != (swapped % 2 == 1)
    known = known.withColumn("inside", inside)
    deeper = F.when(F.col("inside"), F.col("deeper_1")).otherwise(F.col("deeper_0"))
    return known.withColumn("depth", F.coalesce(F.sum(deeper).over(before), F.lit(0))).select(
        "source_file", "block", "inside", "depth", (F.col("depth") + deeper).alias("end_depth")
    )


def read_documents(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per element of ``data`` of files that hold one ``{name, data: [...]}`` object each.

    ``source_file, dataset_name, has_data, story_index, item``, as many tasks as the files have blocks
    (``spark.sql.files.maxPartitionBytes``). A file without elements has one row without an item. A file that does not
    end with its object, or an element that does not parse, raises.
    """
    raw = spark.read.option("lineSep", "}").text(paths).select(
        "value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block")
    )
    sums = raw.mapInArrow(_summaries, "source_file string, block long, open_0 boolean, deeper_0 long, open_1 boolean, deeper_1 long")
    starts = written(_starts(sums), "blocks")
    # One row a block; where that is too much to send to every task, rows are brought to their block in order.
    rows = raw.withColumn("line", F.monotonically_increasing_id()).join(starts, ["source_file", "block"])
    ordered = rows.select("value", "source_file", "block", "inside", "depth", "line").sortWithinPartitions("source_file", "block", "line")
    pieces = written(ordered.mapInArrow(_cut, _PIECES), "pieces")

    by_block = W.partitionBy("source_file").orderBy("block", "region")
    regions = pieces.filter("text is null").withColumn("of", F.last("key", ignorenulls=True).over(by_block))
    counted = F.when(F.col("of") == "data", F.col("local")).otherwise(0)
    regions = written(
        regions.withColumn("before", F.coalesce(F.sum(counted).over(by_block.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(
            "source_file", "block", "region", "of", "before"
        ),
        "regions",
    )
    placed = pieces.filter("text is not null").join(regions, ["source_file", "block", "region"])
    elements = placed.filter("of = 'data'").select(
        "source_file", (F.col("before") + F.col("local")).alias("story_index"), "block", "seq", "opens", "closes", "text"
    )
    whole = elements.filter("opens and closes").select("source_file", "story_index", "text")
    cut = elements.filter("not (opens and closes)").groupBy("source_file", "story_index").agg(_together())
    names = placed.filter("of = 'name'").groupBy("source_file").agg(_together().alias("name"))
    wrong = F.raise_error(F.concat(F.col("source_file"), F.lit(" does not end with its object"))).cast("long")
    # The last piece of a file has a bracket too many, unless nothing follows its last one.
    end = F.max_by("end_depth", "block")
    files = starts.groupBy("source_file").agg(F.when(end.isin(0, -1), end).otherwise(wrong).alias("end")).filter("end <= 0")
    has = regions.groupBy("source_file").agg(F.bool_or(F.col("of") == "data").alias("has_data"))
    head = files.join(has, "source_file", "left").join(names, "source_file", "left").select(
        "source_file", _dataset_name(F.try_parse_json("name").cast("string"), F.col("source_file")).alias("dataset_name"),
        F.coalesce("has_data", F.lit(False)).alias("has_data"),
    )
    found = whole.unionByName(cut).select("source_file", "story_index", F.parse_json("text").alias("item"))
    return head.join(found, "source_file", "left").select("source_file", "dataset_name", "has_data", "story_index", "item")


def _together() -> Column:
    """The pieces of one value in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "seq", "text"))), lambda p: p["text"]), "").alias("text")


def _dataset_name(name: Column, file_path: Column) -> Column:
    stem = F.regexp_replace(F.regexp_extract(file_path, r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(name, stem)
