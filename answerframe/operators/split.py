"""Train/evaluation splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from answerframe.constants import TASKS
from answerframe.session import written

# A level of the selection fixes so many bits of the hash: 2 ** 14 counts per task at most.
_LEVEL_BITS = 14


def _hash(seed: int, parts: Sequence[str]) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def stratified_split(
    questions: DataFrame, eval_ratio: float = 0.2, seed: int = 42, key: Sequence[str] = ("source_file", "key")
) -> DataFrame:
    """Add ``is_eval``: per task the ``max(1, half-even round of n·ratio)`` rows with the
    smallest hash (none of a single row). A task that the contract does not know is an error.

    The cut is found by radix selection: a histogram of the hash's leading bits says, per task, in which
    of them the cut falls, the next one looks at the following bits of these rows only, and so on until
    the counts end at the cut. No row is ever ranked or gathered, each histogram has partial
    counts before its shuffle, and what the driver sees is one row per task. The counts read a written table of
    hashes only. Deterministic in (seed, key), whatever the partitioning; rows of equal key are on one side
    or, where the cut falls between them, all on the evaluation side.
    """
    unknown = F.raise_error(F.concat(F.lit("unsupported task: "), F.coalesce("q_type", F.lit("null")))).cast("string")
    checked = F.when(F.col("q_type").isin(*TASKS), F.col("q_type")).otherwise(unknown)
    digest = _hash(seed, key)
    # The order of the whole hash, as two whole numbers of 60 and 64 bits.
    high = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    low = (F.conv(F.substring(digest, 16, 15), 16, 10)).cast("bigint")
    tagged = questions.withColumns({"_high": high, "_low": low})
    hashes = written(tagged.select(checked.alias("q_type"), "_high", "_low"), "hashes")
    cuts = _cuts(hashes, eval_ratio)
    size = F.when(F.lit(False), F.lit(False))
    for task, (top, bottom) in cuts.items():
        below = (F.col("_high") < top) | ((F.col("_high") == top) & (F.col("_low") <= bottom))
        size = size.when(F.col("q_type") == task, below)
    known = F.when(checked.isNotNull(), F.coalesce(size.otherwise(False), F.lit(False)))
    return tagged.withColumn("is_eval", known).drop("_high", "_low")


def _cuts(hashes: DataFrame, eval_ratio: float) -> dict[str, tuple[int, int]]:
    """Per task the last hash, as two numbers, of the evaluation side. Tasks of a single row have none."""
    counts = {r["q_type"]: r["n"] for r in hashes.groupBy("q_type").agg(F.count("*").alias("n")).collect()}
    # Of each task: bits fixed in the two numbers so far, and how many rows are still to be taken below the cut.
    open_cuts = {t: [0, 0, max(1, _half_even(n * eval_ratio))] for t, n in counts.items() if n > 1}
    cuts: dict[str, tuple[int, int]] = {}
    for part, name in enumerate(("_high", "_low")):
        fixed = 0
        while open_cuts and fixed < 60:
            bits = min(_LEVEL_BITS, 60 - fixed)
            rest = 60 - fixed - bits
            here = F.lit(False)
            for task, (top, bottom, _) in open_cuts.items():
                same = F.shiftright(name, 60 - fixed) == ((top, bottom)[part] >> (60 - fixed))
                here = here | ((F.col("q_type") == task) & same & (F.col("_high") == top if part else F.lit(True)))
            bucket = F.shiftright(name, rest).alias("bucket")
            # At most 2 ** _LEVEL_BITS counts per task of the contract; running sums end at the one bucket of the cut.
            found = hashes.filter(here).groupBy("q_type", bucket).agg(F.count("*").alias("n"))
            upto = F.sum("n").over(W.partitionBy("q_type").orderBy("bucket"))
            wanted = F.create_map(*[F.lit(x) for t, (_, _, need) in open_cuts.items() for x in (t, need)])
            need = F.element_at(wanted, F.col("q_type"))
            cut = found.withColumn("upto", upto).filter((F.col("upto") >= need) & (F.col("upto") - F.col("n") < need))
            for row in cut.collect():
                task, taken = row["q_type"], open_cuts[row["q_type"]]
                taken[part] = row["bucket"] << rest
                taken[2] -= row["upto"] - row["n"]
                if taken[2] == row["n"]:
                    # The cut is the end of this bucket.
                    taken[part] |= (1 << rest) - 1
                    cuts[task] = (taken[0], taken[1] if part else 1 << 61)
            open_cuts = {t: c for t, c in open_cuts.items() if t not in cuts}
            fixed += bits
    return {**cuts, **{t: (c[0], c[1]) for t, c in open_cuts.items()}}


def _half_even(x: float) -> int:
    return round(x)


def story_split(
    questions: DataFrame, eval_ratio: float = 0.2, seed: int = 42, story: Sequence[str] = ("dataset_name", "story_index")
) -> DataFrame:
    """Add ``is_eval`` so that all questions of a story, per dataset, are on one side.

    The side is a function of the story's own hash: no shuffle. The share of stories is
    ``eval_ratio`` in expectation.
    """
    share = F.conv(F.substring(_hash(seed, story), 1, 8), 16, 10).cast("bigint")
    return questions.withColumn("is_eval", share < F.lit(int(eval_ratio * 2**32)))


def split_overlap(split: DataFrame, story: Sequence[str] = ("dataset_name", "story_index")) -> DataFrame:
    """Stories with questions on both sides of a split."""
    sides = split.groupBy(*story).agg(
        F.count_if(~F.col("is_eval")).alias("train_questions"), F.count_if("is_eval").alias("eval_questions")
    )
    return sides.filter("train_questions > 0 AND eval_questions > 0")
