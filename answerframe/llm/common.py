"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(parts))


def share_of(bound: int, rows: DataFrame, *keys: str) -> Column:
    """True for about ``bound`` of the rows, chosen by a hash of ``keys``; for all, if there are fewer.

    The choice does not depend on how the rows are stored, so a rerun picks the same ones.
    """
    share = min(1.0, bound / max(1, rows.count()))
    return F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def words(text: str | None) -> list[bytes]:
    """The words of a text: A-Z in lower case, parted by space, tab, line breaks and form feeds.

    ``bytes.lower`` and ``bytes.split`` touch ASCII only, which is exactly that rule.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def blocks(texts: Sequence[str | None], budget: int) -> Iterator[slice]:
    """Slices of a batch with about ``budget`` characters each, so that arrays stay small.

    A single longer text is a slice of its own and is never cut.
    """
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and size + n > budget:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def lean(run: Callable) -> Callable:
    """``run`` over batches, which at its end gives the memory it has freed back to the system.

    Python workers outlive their tasks; what their allocators keep would add up with that of later stages.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def map_rows(docs: DataFrame, run: Callable, added: Sequence[T.StructField]) -> DataFrame:
    """``mapInPandas`` over rows that keep all their columns and get ``added`` ones.

    Whole numbers pass as text: pandas would turn a column with a null into floats, which cannot hold large ids.
    """
    whole = [f for f in docs.schema.fields if isinstance(f.dataType, T.IntegralType)]
    names = {f.name for f in whole}
    cast = lambda df, to: df.select(*[F.col(f"`{c}`").cast(to[c]).alias(c) if c in to else F.col(f"`{c}`") for c in df.columns])
    fields = [T.StructField(f.name, T.StringType()) if f.name in names else f for f in docs.schema.fields]
    mapped = cast(docs, dict.fromkeys(names, "string")).mapInPandas(lean(run), T.StructType([*fields, *added]))
    return cast(mapped, {f.name: f.dataType for f in whole})
