"""Source divergence against a plain reading, and the skyband against counting all dominators."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from answerframe.llm import divergence

SCHEMA = "lang string, source string, text string"


def plain(rows, min_docs, ranks):
    rows = [tuple(x or "" for x in row) for row in rows]
    lower = lambda w: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
    count, docs, out = defaultdict(Counter), defaultdict(Counter), []
    for lang, source, text in rows:
        words = [lower(w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]
        count[lang, source].update(words)
        docs[lang].update(set(words))
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = sorted(s for la, s in count if la == lang)

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            others = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            own = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:ranks]
            for part, items in (("pair", others), ("term", own)):
                out += [(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(items, 1)]
    return sorted(out)


def some_rows(n, sources, seed):
    rng = random.Random(seed)
    pool = ["Aa", "aa", "bB", "c-d", "é", "É", "zz9q", "日本", "the", "THE", "", "x" * 50]
    text = lambda: " ".join(rng.choices(pool, weights=range(1, 13), k=rng.randint(0, 9)))
    return [(rng.choice(["a", None, "b"]), f"s{rng.randrange(sources):03d}", text()) for _ in range(n)] + [
        ("z", "s1", None), ("z", None, "one"), ("only", "s1", ""), (None, None, None),
    ]


@pytest.mark.parametrize(("n", "sources", "min_docs", "ranks"), [(300, 5, 3, 2), (300, 5, 30, 50), (600, 150, 4, 3)])
def test_equals_plain_reading(spark, n, sources, min_docs, ranks):
    rows = some_rows(n, sources, n + sources)
    found = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(5), min_docs, ranks)
    assert sorted(map(tuple, found.collect())) == plain(rows, min_docs, ranks)


def test_empty_table_and_further_columns(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("a", "x", "w"), ("a", "y", None)]
    more = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], SCHEMA + ", n int, term string, lang_n int")
    assert sorted(map(tuple, divergence.audit(more, 1, 5).collect())) == plain(rows, 1, 5)


def test_long_text_counts_whole(spark):
    rows = [("a", "x", "end " * 200_000 + "last"), ("a", "y", "last")]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, SCHEMA), 1, 5).collect())) == plain(rows, 1, 5)


def test_shares_of_large_counts_are_exact(spark):
    cases = [(0, 0, 1), (5 * 10**11, 10**13, 10**6), (10**14, 10**15, 3), (7, 7, 1), (0, 0, 0)]
    rows = spark.createDataFrame(cases, "c long, total long, kept long").select("*", divergence.share("c", "total", "kept").alias("p"))
    for c, total, kept, p in rows.collect():
        by = total + 5 * kept
        assert p == (1 + 10**9 * (c + 5) // by if by else None)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_skyband(k):
    rng = np.random.default_rng(k)
    first, second = rng.integers(0, 12, 700), rng.integers(0, 12, 700)
    third = rng.permutation(700)
    above = (first[None] >= first[:, None]) & (second[None] <= second[:, None]) & (third[None] <= third[:, None])
    assert sorted(divergence.skyband(first, second, third, k, 64)) == np.flatnonzero(above.sum(1) - 1 < k).tolist()


def test_skybands_compare_again_and_pass_on(spark):
    rows = [("a", f"s{i % 3}", f"t{i:05d}", i % 97, i % 89) for i in range(9000)]
    cells = spark.createDataFrame(rows, "lang string, source string, term string, n long, lang_n long").coalesce(1)
    local = divergence._skybands(cells, 4, most=100)
    merged = {tuple(r) for r in divergence._skybands(local.coalesce(1), 4).collect()}
    for s in range(3):
        own = [r for r in rows if r[1] == f"s{s}"]
        a = np.array([(r[3], r[4], i) for i, r in enumerate(own)])
        want = {own[i] for i in divergence.skyband(a[:, 0], a[:, 1], a[:, 2], 4)}
        assert {r for r in merged if r[1] == f"s{s}"} == want
