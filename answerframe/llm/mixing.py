"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words; its documents are all expected ``target / size``
times, at most ``max_epochs``. Within a source the expected copies are summed up in the order
of document size, one random offset is added, and a document is emitted once for every whole
number that its step crosses. Neighbours in that order are about equally long, so the words
taken differ from the target by about one document at most.

The running sum over a source, which may hold a third of all rows, needs no task that sees the
whole source: rows are range-sorted, and only the number of rows per sort partition is shared.

Nulls and ties: a null text has size 0; a null source is a source of its own, sorted last.
Documents of equal size are ordered by id and text; rows equal in all of that are
interchangeable. A source without words has target 0 and takes nothing. Null ids are allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerframe.operators.select import with_position
from answerframe.session import written

_WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """``source, source_size, n_docs, first, target``: words wanted from each source.

    ``sizes`` has ``source, source_size, n_docs``. ``weights`` repeat over the sources by code
    point, null last. ``first`` is the number of documents in the sources before it. What a
    source cannot give is shared out again, by weight, until no target is above its limit.
    """
    ordered = with_position(sizes.withColumn("missing", F.col("source").isNull()), ["missing", "source"], "ordinal").drop("selected")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("ordinal") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = written(ordered.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(max_epochs)), "mix-sources")
    total = (rows.agg(F.sum("source_size").alias("n")).first()["n"] or 0) * share
    # Fill the water level: a source at its limit stays there, as the level only rises.
    level, before = 0.0, -1
    while True:
        capped = F.col("limit") <= F.col("weight") * level
        s = rows.agg(
            F.sum(F.when(capped, F.col("limit")).otherwise(0.0)).alias("given"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.count_if(capped).alias("n"),
        ).first()
        if s["n"] == before or not s["weight"]:
            break
        level, before = (total - s["given"]) / s["weight"], s["n"]
    return rows.withColumn("target", F.least(F.col("limit"), F.col("weight") * level)).drop("weight", "limit", "missing", "ordinal")


def offset(source: Column, seed: int) -> Column:
    """A fixed random number from 0 to 1 for each source."""
    bits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))), 1, 12)
    return F.conv(bits, 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` and the columns ``keep``, for every row."""
    rows = docs.select(
        "doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"),
        F.col("source").isNull().alias("missing"), *[F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)],
    )
    # Positions follow (source, size, id); written once, since the sort needs it several times.
    placed = with_position(rows, ["missing", "source", "size", "doc_id", "text_hash"], "place").drop("selected")
    sizes = placed.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_docs"), F.min("place").alias("first")
    )
    wanted = targets(sizes, weights, share, max_epochs)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = F.col("place") - F.col("first")
    crossed = lambda k: F.floor(offset(F.col("source"), seed) + each * k)
    # A null-safe join on the hash part of the key would not spread a large source: the adaptive
    # plan broadcasts the sources if they are few and splits a large source's rows otherwise.
    key = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))
    joined = placed.withColumn("mix_key", key(F.col("source"))).join(
        wanted.withColumn("mix_key", key(F.col("source"))).drop("source"), "mix_key"
    )
    copies = (crossed(at + 1) - crossed(at)).cast("bigint")
    return joined.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)],
    )
