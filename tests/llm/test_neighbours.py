"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from answerframe.llm import neighbours


def brute(rows, queries, k=5):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8}
    out = {}
    for q, u in good:
        if queries(q):
            best = {}
            for i, v in good:
                if i != q:
                    a, b = np.array(u), np.array(v)
                    best[i] = max(best.get(i, -2), float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))))
            out[q] = sorted(best, key=lambda i: (-round(best[i], 12), i))[:k]
    return out


def test_search_and_edges(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(12)] + [(50, rows[50][1])]
    rows += [(None, rows[1][1]), (2000, None), (2050, [0.0] * 8), (2100, [None] + [1.0] * 7), (2150, [float("nan")] * 8), (2200, [1.0, 2.0]), (2250, [])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<float>")
    asks = lambda q: q % 50 == 0
    got = {}
    for r in neighbours.search(frame, F.col("vec_id") % 50 == 0, list_size=40, chunk=30).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(rows, asks)
    assert set(got) == set(want) and got[0] == want[0] == [1000, 1001, 1002, 1003, 1004]
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_few_or_no_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0])], "vec_id long, vector array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in neighbours.search(frame, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 1)]
    assert neighbours.search(frame.limit(0), F.col("vec_id") == 0).count() == 0
