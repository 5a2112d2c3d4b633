"""Approximate nearest neighbours by cosine, over balanced posting lists.

A bounded sample of vectors (``sample``, chosen by a hash of the id) is split again and again at
the median between two means, so that every list gets about equally many; the lists' centres are
few (``max_lists`` at most) and are broadcast with a graph of their nearest centres. Every
vector is put on the list of its nearest centre and, if it lies near a border, on those of
further centres within a distance ratio. A query takes the centres within a larger ratio, a share
of all lists at most, so that recall does not fall as lists become more; so many are found by
a scan of all centres, fewer by a walk of the graph. It is compared with all vectors of their
lists in double precision. Queries that got fewer than ``k`` results ask all lists.

Lists are dealt in chunks of bounded size by a hash of the vector, and so are the queries of a
list, so no task holds a whole list however the vectors are spread. Bit-equal vectors are
indexed once, with as many of their smallest ids as an answer can use, found by a ranking that
is cut per task before the shuffle.

Nulls and ties: null vectors, zero vectors, vectors with null or non-finite components, of
another length than most, or without an id take no part, neither as queries nor as candidates.
Equal scores go to the smaller id. Repeated rows of an id and vector count once; an id with
several vectors is a query, and a candidate, for each, and is answered with its best. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerframe.llm.common import share_of
from answerframe.session import written


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def balanced_centres(x: np.ndarray, n_lists: int, seed: int = 3) -> np.ndarray:
    """Centres of ``n_lists`` parts of about equal size: halves at the median between two means."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(x))]
    while len(parts) < n_lists:
        parts.sort(key=len)
        part = parts.pop()
        if len(part) < 2:
            parts.append(part)
            break
        own = x[part]
        a, b = own[rng.choice(len(own), 2, replace=False)]
        for _ in range(6):
            nearer = own @ (a - b) > 0
            if nearer.all() or not nearer.any():
                break
            a, b = _unit(own[nearer].mean(axis=0)), _unit(own[~nearer].mean(axis=0))
        order = np.argsort(own @ (a - b), kind="stable")
        parts += [part[order[: len(order) // 2]], part[order[len(order) // 2 :]]]
    return _unit(np.stack([x[p].mean(axis=0) for p in parts if len(p)]))


@dataclass
class Graph:
    centres: np.ndarray
    links: np.ndarray  # the nearest other centres of each, and some far ones
    entries: np.ndarray

    def nearest(self, x: np.ndarray, n: int, breadth: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """Centres and cosines, best first, for each row: best-first walks of all rows in step.

        Each walk keeps its ``breadth`` best centres and visits the best one it has not visited. If more
        than that are asked for, all centres are compared instead.
        """
        if n > breadth:
            every = x @ self.centres.T
            n = min(n, len(self.centres))
            ids = np.argpartition(-every, n - 1, axis=1)[:, :n]
            cosines = np.take_along_axis(every, ids, axis=1)
            order = np.lexsort((ids, -cosines), axis=1)
            return np.take_along_axis(ids, order, axis=1), np.take_along_axis(cosines, order, axis=1)
        breadth = min(breadth, len(self.centres))
        rows = np.arange(len(x))[:, None]
        seen = np.zeros((len(x), len(self.centres)), dtype=bool)
        ids = np.tile(self.entries, (len(x), 1))
        seen[rows, ids] = True
        cosines = x @ self.centres[self.entries].T
        visited = np.zeros(ids.shape, dtype=bool)
        while True:
            order = np.argsort(-cosines, axis=1, kind="stable")[:, :breadth]
            ids, cosines, visited = (np.take_along_axis(v, order, axis=1) for v in (ids, cosines, visited))
            open_rows = np.flatnonzero((~visited & np.isfinite(cosines)).any(axis=1))
            if not len(open_rows):
                return ids[:, :n], cosines[:, :n]
            at = (~visited & np.isfinite(cosines))[open_rows].argmax(axis=1)
            visited[open_rows, at] = True
            new = self.links[ids[open_rows, at]]
            fresh = ~seen[open_rows[:, None], new]
            seen[open_rows[:, None], new] = True
            found = np.full((len(x), new.shape[1]), -np.inf, dtype=cosines.dtype)
            found[open_rows] = np.where(fresh, np.einsum("rd,rkd->rk", x[open_rows], self.centres[new]), -np.inf)
            more = np.zeros((len(x), new.shape[1]), dtype=ids.dtype)
            more[open_rows] = new
            ids, cosines = np.concatenate([ids, more], axis=1), np.concatenate([cosines, found], axis=1)
            visited = np.concatenate([visited, np.zeros(more.shape, dtype=bool)], axis=1)


def link(centres: np.ndarray, degree: int = 24, seed: int = 3) -> Graph:
    n, rng = len(centres), np.random.default_rng(seed)
    links = np.empty((n, min(degree, n)), dtype=np.int64)
    for k in range(0, n, 512):
        near = np.argsort(-(centres[k : k + 512] @ centres.T), axis=1, kind="stable")[:, : links.shape[1]]
        links[k : k + 512] = near
    if n > degree:
        links[:, -4:] = rng.integers(0, n, (n, 4))  # so that the graph hangs together
    return Graph(centres.astype(np.float32), links, np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64)))


def within(cosines: np.ndarray, ratio: float) -> np.ndarray:
    """True where a centre's distance is at most ``ratio`` times the nearest one's."""
    distance = np.sqrt(np.maximum(0.0, 2 - 2 * cosines))
    return np.isfinite(cosines) & (distance <= ratio * np.maximum(distance[:, :1], 1e-3))


def _deal(rows: DataFrame, graph: Graph, most: int, ratio: float) -> DataFrame:
    """``rows`` with ``list``, one row for each list that takes its vector."""
    shared = rows.sparkSession.sparkContext.broadcast(graph)
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 1024):
                part = batch.iloc[k : k + 1024]
                x = _unit(np.stack(part["vector"].to_numpy()).astype(np.float64)).astype(np.float32)
                ids, cosines = shared.value.nearest(x, most)
                take = within(cosines, ratio)
                row, col = np.nonzero(take)
                out = part.iloc[row].copy()
                out["list"] = ids[row, col]
                yield out[[*columns, "list"]]

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, list long")


def best_of(query_ids: np.ndarray, queries: np.ndarray, ids: list, vectors: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """The ``k`` best candidates of each query; ``ids`` holds the ids of each vector."""
    norms, sizes = np.sqrt((vectors * vectors).sum(axis=1)), [len(i) for i in ids]
    own = np.repeat(np.arange(len(ids)), sizes)
    flat = np.concatenate([np.asarray(i, dtype=np.int64) for i in ids])
    for q, query in zip(query_ids, queries, strict=True):
        # Element-wise products and a sum over the row: the same bits in every group.
        scores = (vectors * query).sum(axis=1) / (norms * np.sqrt((query * query).sum()))
        least = np.partition(scores, -(k + 1))[-(k + 1)] if len(scores) > k + 1 else -np.inf
        at = np.flatnonzero((scores[own] >= least) & (flat != q))
        at = at[np.lexsort((flat[at], -scores[own[at]]))][:k]
        yield from ((int(q), int(flat[i]), float(scores[own[i]])) for i in at)


def search(
    vectors: DataFrame, queries: Column, k: int = 5, list_size: int = 128, max_lists: int = 8192, sample: int = 40_000,
    replicas: int = 4, replica_ratio: float = 1.1, probes: int = 96, probe_share: float = 1 / 12, probe_ratio: float = 1.6, chunk: int = 2000,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: nearest rows of ``vec_id, vector`` for those where ``queries`` holds.

    A query asks up to ``probes`` lists, or ``probe_share`` of all if these are more.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "vector", queries.alias("asks")).filter(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if length is None:
        return empty
    distinct = rows.filter(F.size("vector") == length["n"]).groupBy("vector", "vec_id").agg(F.bool_or("asks").alias("asks"))
    distinct = written(distinct, "ann-rows")
    # A vector's copies: the k smallest ids and one more, in case the query is among them.
    place = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    base = distinct.select("vector", "vec_id", place.alias("place")).filter(F.col("place") <= k + 1)
    base = written(base.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-vectors")
    n = base.count()
    picked = base.filter(share_of(sample, base, "vector")).orderBy(F.xxhash64("vector")).select("vector").limit(sample).toPandas()
    x = _unit(np.stack(picked["vector"].to_numpy()).astype(np.float64))
    graph = link(balanced_centres(x, min(max_lists, max(1, n // list_size), len(x))))

    lists = written(_deal(base, graph, replicas, replica_ratio), "ann-lists")
    asks = distinct.filter("asks").select(F.col("vec_id").alias("query_id"), "vector")
    most = max(probes, int(np.ceil(probe_share * len(graph.centres))))
    once = written(_candidates(lists, written(_deal(asks, graph, most, probe_ratio), "ann-queries"), k, chunk), "ann-near")
    short = asks.select("query_id").distinct().join(once.groupBy("query_id").count().filter(F.col("count") >= k), "query_id", "left_anti")
    if not short.isEmpty():
        every = lists.select("list").distinct()
        again = written(asks.join(short, "query_id", "left_semi").crossJoin(F.broadcast(every)), "ann-again")
        again = _candidates(lists, again, k, chunk)
        once = once.join(short, "query_id", "left_anti").unionByName(again)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _candidates(lists: DataFrame, asked: DataFrame, k: int, chunk: int) -> DataFrame:
    """``query_id, vec_id, score``: the best of every list that a query asks, a candidate once."""
    # Sizes of the lists decide into how many chunks each side of a list is dealt; there are ``max_lists`` at most.
    count = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / chunk).cast("int").alias(name))
    sizes = F.broadcast(count(lists, "parts").join(count(asked, "asked_parts"), "list"))
    left = lists.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("vector"), F.col("parts")).cast("int")).withColumn(
        "asked_part", F.explode(F.sequence(F.lit(0), F.col("asked_parts") - 1))
    )
    right = asked.join(sizes, "list").withColumn("asked_part", F.pmod(F.xxhash64("query_id"), F.col("asked_parts")).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    key = ["list", "part", "asked_part"]

    def compare(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(ask):
            at, q = (np.stack(f["vector"].to_numpy()).astype(np.float64) for f in (own, ask))
            found = list(best_of(ask["query_id"].to_numpy(), q, own["ids"].tolist(), at, k))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    near = (
        left.select(*key, "ids", "vector").groupBy(*key)
        .cogroup(right.select(*key, "query_id", "vector").groupBy(*key))
        .applyInPandas(compare, "query_id long, vec_id long, score double")
    )
    # A candidate may come from several lists.
    return near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
