"""Source divergence audit: how the sources of a language differ in their words.

Each language keeps the terms found in at least ``min_docs`` of its documents. Every group (language
and source) and every language gives a kept term the smoothed share ``p = 1 + floor(scale * (count
+ prior) / (N + prior * V))``, in whole numbers throughout. ``pairs`` sums the absolute differences of two
sources over all kept terms; ``terms`` lists what a source uses most above its language.

``terms`` is a dominance skyband. The difference ``p - q`` grows with a term's count in the group
and falls with its count in the language, and ties go to the term that is first in UTF-8. So
a term that ``ranks`` others dominate in all three cannot be among the first ``ranks``. Every partition
keeps the terms of a group that fewer than ``ranks`` others dominate, the skybands of a group are merged
in the same way, and only what is left is ranked, exactly.

``pairs`` works on tiles of ``TILE`` by ``TILE`` sources and a hash bucket of terms, so neither a frequent term nor
a language with many sources is one task's work; a pair's output is its sum per tile. No row is made for a
pair of sources and a term.

Text is read once. Counts are added up in the Python worker (at most ``HELD`` entries) and again before each
shuffle; what is shuffled are distinct (language, source, term). Nothing is broadcast by name.

Nulls and ties: null text, lang and source are the empty string. A group without kept terms has all its
pairs, with the shares of absent terms, and no terms. A language that keeps no term has pairs of value 0.
Repeated rows are documents of their own. An empty table gives no rows. Other columns are ignored.
Counts may go up to 9e15 words a language.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from answerframe.session import written

PRIOR = 5
SCALE = 1_000_000_000
TILE = 64
HELD = 400_000
# A-Z become a-z; all other ASCII but a-z parts the terms.
_TABLE = bytes(b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term in each group.

    Each group also has a row with a null term, whose ``docs`` are all its documents. All rows of a
    language's term are in one partition, as many as the language has sources.
    """
    schema = "lang string, source string, term string, n long, docs long"
    types = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = defaultdict(Counter)
        within: dict = defaultdict(Counter)

        def emit() -> Iterator[pa.RecordBatch]:
            for (lang, source), documents in within.items():
                counts = total[lang, source]
                names = list(documents)
                for k in range(0, len(names), 20_000):
                    part = names[k : k + 20_000]
                    columns = [[lang] * len(part), [source] * len(part), part, [counts.get(t, 0) for t in part], [documents[t] for t in part]]
                    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                    arrays[2] = arrays[2].cast(pa.string())
                    yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])
            total.clear()
            within.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, documents = terms_of(text), within[lang, source]
                held -= len(documents)
                total[lang, source].update(found)
                documents.update(set(found))
                documents[None] += 1
                held += len(documents)
                if held > HELD:
                    yield from emit()
                    held = 0
        yield from emit()

    known = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    # Dealt out by term and language, one shuffle serves the sums here and those over sources that follow.
    dealt = known.mapInArrow(run, schema).repartition("term", "lang")
    return dealt.groupBy("term", "lang", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, kept: str) -> F.Column:
    """``1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept))`` of columns, by long division in base 1,000."""
    by = f"({total} + {PRIOR} * {kept})"
    digits, rest = [], f"({count} + {PRIOR})"
    for k in range(3):
        above = f"({rest} * 1000)" if k == 0 else f"(({rest}) * 1000)"
        digits.append(f"({above} div {by})")
        rest = f"{above} % {by}"
    return F.when(F.expr(by) > 0, F.expr(f"1 + ({digits[0]} * 1000 + {digits[1]}) * 1000 + {digits[2]}"))


def skyband(first: np.ndarray, second: np.ndarray, third: np.ndarray, k: int, step: int = 256) -> np.ndarray:
    """Places of the points that fewer than ``k`` others dominate: ``first`` higher, ``second`` and ``third`` lower, or equal.

    No two points are equal in all. In this order a point's dominators stand before it, and if there are ``k``
    of them, ``k`` are in the skyband themselves, so each point is compared with those kept only.
    """
    order = np.lexsort((third, second, -first))
    kept, low, early = [], np.zeros(0, second.dtype), np.zeros(0, third.dtype)
    for at in range(0, len(order), step):
        block = order[at : at + step]
        b, c = second[block], third[block]
        above = ((low[None, :] <= b[:, None]) & (early[None, :] <= c[:, None])).sum(axis=1)
        above += np.tril((b[None, :] <= b[:, None]) & (c[None, :] <= c[:, None]), -1).sum(axis=1)
        stay = above < k
        kept.append(block[stay])
        low, early = np.concatenate([low, b[stay]]), np.concatenate([early, c[stay]])
    return np.concatenate(kept) if kept else order


def _skybands(cells: DataFrame, k: int, most: int = 50_000) -> DataFrame:
    """The skyband of each group within each partition of ``lang, source, term, n, lang_n``; other columns go along."""

    def reduce(parts: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(parts).combine_chunks()
        names = table.column("term").cast(pa.binary()).to_pylist()
        place = np.empty(len(names), dtype=np.int64)
        place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        return table.take(pa.array(np.sort(skyband(table.column("n").to_numpy(), table.column("lang_n").to_numpy(), place, k))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of each group: parts not yet compared, their rows, and the rows at which to compare them.
        waiting: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            keys = list(zip(table.column("lang").to_pylist(), table.column("source").to_pylist(), strict=True))
            number = {key: i for i, key in enumerate(dict.fromkeys(keys))}
            whose = np.fromiter((number[key] for key in keys), dtype=np.int64, count=len(keys))
            order = np.argsort(whose, kind="stable")
            edges = np.searchsorted(whose[order], np.arange(len(number) + 1))
            for key, i in number.items():
                part = table.take(pa.array(order[edges[i] : edges[i + 1]]))
                own = waiting.setdefault(key, [[], 0, 2_000])
                own[0].append(part)
                own[1] += part.num_rows
                if own[1] >= own[2]:
                    left = reduce(own[0])
                    own[:] = [[left], left.num_rows, 2 * left.num_rows + 2_000]
            # What is held stays bounded: with very many groups, skybands so far are passed on.
            if sum(own[1] for own in waiting.values()) > 20 * most:
                for own in waiting.values():
                    yield from reduce(own[0]).to_batches(most)
                waiting = {}
        for own in waiting.values():
            yield from reduce(own[0]).to_batches(most)

    return cells.mapInArrow(run, cells.schema)


def kept_cells(counts: DataFrame, min_docs: int) -> DataFrame:
    """``lang, source, term, n, lang_n, opens``: the kept terms in each group that has them; ``opens`` marks one row a term.

    The rows with a null term stay. The term comes first in the sort, since it tells rows apart.
    """
    by_term = W.Window.partitionBy("term", "lang")
    return (
        counts.withColumn("lang_docs", F.sum("docs").over(by_term))
        .filter(F.col("term").isNull() | (F.col("lang_docs") >= min_docs))
        .withColumn("lang_n", F.sum("n").over(by_term))
        .withColumn("opens", F.row_number().over(by_term.orderBy("source")) == 1)
        .select("lang", "source", "term", "n", "lang_n", "opens")
    )


def groups(cells: DataFrame) -> DataFrame:
    """``lang, source, total, kept, lang_total, ordinal, base`` of every group; ``base`` is its share of an absent term, 0 where no term is kept."""
    langs = cells.groupBy("lang").agg(F.count_if(F.col("opens") & F.col("term").isNotNull()).alias("kept"), F.sum("n").alias("lang_total"))
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    ordinal = F.row_number().over(W.Window.partitionBy("lang").orderBy("source")) - 1
    return (
        own.join(langs, "lang").withColumn("ordinal", ordinal).withColumn("base", F.coalesce(share("0", "total", "kept"), F.lit(0)))
    )


def with_shares(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """The cells of kept terms with ``p``, ``q``, and the group's ``ordinal``."""
    known = groups.select("lang", "source", "total", "kept", "lang_total", "ordinal")
    return cells.filter("term is not null").join(known, ["lang", "source"]).select(
        "lang", "source", "term", "n", "lang_n", "ordinal",
        share("n", "total", "kept").alias("p"), share("lang_n", "lang_total", "kept").alias("q"),
    )


def terms(shares: DataFrame, ranks: int) -> DataFrame:
    """``lang, source, item, value, rank``: what each source uses most above its language."""
    # What dominates a term above its language is above it too.
    above = shares.filter("p > q").select("lang", "source", "term", "n", "lang_n", (F.col("p") - F.col("q")).alias("value"))
    merged = _skybands(_skybands(above, ranks).repartition("lang", "source"), ranks)
    order = W.Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return (
        merged.select("lang", "source", F.col("term").alias("item"), "value")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= ranks)
    )


def pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value, rank``: the difference of each source to every other of its language."""
    buckets = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = F.floor(F.col("ordinal") / TILE).cast("int").alias("side")
    lists = [F.col("c")["ordinal"].alias("ordinals"), F.col("c")["p"].alias("shares")]
    side_list = groups.groupBy("lang", side).agg(F.sort_array(F.collect_list(F.struct("ordinal", F.col("base").alias("p")))).alias("c"))
    side_list = side_list.select("lang", "side", *lists)
    last = groups.groupBy("lang").agg(F.floor(F.max("ordinal") / TILE).cast("int").alias("last"))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    # A term's shares on one side, at most TILE, go to every tile of that side. Heads name a tile's sources to each bucket.
    bodies = (
        shares.groupBy("term", "lang", side).agg(F.collect_list(F.struct("ordinal", "p")).alias("c"))
        .select("lang", "side", bucket.alias("bucket"), "term", *lists)
    )
    heads = side_list.select("lang", "side", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(None).cast("string").alias("term"), "ordinals", "shares")
    tiled = heads.unionByName(bodies).join(last, "lang").select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    tile = ["lang", "i", "j", "bucket"]
    ordered = (
        tiled.select("lang", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "bucket", "term", "side", "ordinals", "shares")
        .repartition(*tile).sortWithinPartitions(*tile, F.col("term").asc_nulls_first(), "side")
    )
    sums = ordered.mapInArrow(_tile_sums, "lang string, a int, b int, part long").groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))

    left = groups.select("lang", F.col("ordinal").alias("a"), F.col("source").alias("source_a"), F.col("base").alias("base_a"), "kept")
    right = groups.select("lang", F.col("ordinal").alias("b"), F.col("source").alias("source_b"), F.col("base").alias("base_b"))
    # Every pair of a language's sources is a result, so this join is as large as the result.
    both = left.join(right, "lang").filter("a < b").join(sums, ["lang", "a", "b"], "left")
    apart = F.when(F.col("kept") == 0, 0).otherwise(F.col("kept") * F.abs(F.col("base_a") - F.col("base_b")) + F.coalesce("part", F.lit(0)))
    turned = F.explode(F.array(*[F.struct(F.col(f"source_{s}").alias("source"), F.col(f"source_{o}").alias("item")) for s, o in ("ab", "ba")]))
    order = W.Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return (
        both.select("lang", apart.cast("long").alias("value"), turned.alias("s"))
        .select("lang", "s.source", "s.item", "value")
        .withColumn("rank", F.row_number().over(order))
    )


def _tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a tile's terms of ``|p - q|`` less the difference of the two bases, for pairs ``a < b``."""
    key, name, out = None, None, []
    sides: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    rows: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []  # of each term waiting, its shares by side
    total = np.zeros((0, 0), dtype=np.int64)

    def add() -> None:
        """The terms waiting as two dense tables of terms by sources, compared column by column."""
        nonlocal total
        if not rows:
            return
        tables = []
        for s in key[1:3]:
            ordinals, bases = sides[s]
            dense = np.repeat(bases[None, :], len(rows), axis=0)
            for r, known in enumerate(rows):
                if s in known:
                    dense[r, np.searchsorted(ordinals, known[s][0])] = known[s][1]
            tables.append(dense)
        if not total.size:
            total = np.zeros((tables[0].shape[1], tables[1].shape[1]), dtype=np.int64)
        for a, base in enumerate(sides[key[1]][1]):
            total[a] += np.abs(tables[0][:, a : a + 1] - tables[1]).sum(axis=0) - len(rows) * np.abs(base - sides[key[2]][1])
        rows.clear()

    def close() -> None:
        nonlocal total
        add()
        if total.size:
            one, two = sides[key[1]][0], sides[key[2]][0]
            a, b, part = np.repeat(one, len(two)), np.tile(two, len(one)), total.ravel()
            told = (a < b) & (part != 0)
            out.append((key[0], a[told], b[told], part[told]))
        total = np.zeros((0, 0), dtype=np.int64)

    def emit() -> Iterator[pa.RecordBatch]:
        for lang, a, b, part in out:
            arrays = [pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(part, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "a", "b", "part"])
        out.clear()

    for batch in batches:
        lists = [batch.column(c) for c in (6, 7)]
        offsets = lists[0].offsets.to_numpy()
        ordinals, values = (c.values.to_numpy(zero_copy_only=False).astype(np.int64) for c in lists)
        keys = zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)
        for r, (own, term, side) in enumerate(zip(keys, batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
            if own != key:
                close()
                if len(out) >= 64:
                    yield from emit()
                key, name, sides = own, None, {}
            known = ordinals[offsets[r] : offsets[r + 1]], values[offsets[r] : offsets[r + 1]]
            if term is None:
                sides[side] = known
                continue
            if term != name:
                if len(rows) >= 512:
                    add()
                rows.append({})
                name = term
            rows[-1][side] = known
    close()
    yield from emit()


def audit(docs: DataFrame, min_docs: int = 30, ranks: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank``: parts ``pair`` and ``term`` of every group of ``lang, source, text``."""
    cells = written(kept_cells(term_counts(docs), min_docs), "term-cells")
    known = written(groups(cells), "term-groups")
    shares = with_shares(cells, known)
    parts = [("pair", pairs(shares, known)), ("term", terms(shares, ranks))]
    one, two = (
        df.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
        for name, df in parts
    )
    return one.unionByName(two)
