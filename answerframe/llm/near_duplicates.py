"""Near-duplicate documents by MinHash, with sequential Bayesian verification.

Texts become sets of distinct five-word shingles. Bands of the MinHash signatures give candidate
pairs; a pair's signatures are compared batch by batch, and it is dropped as soon as the
posterior probability that its similarity reaches the threshold falls below ``miss`` (uniform
prior). What survives all batches is verified exactly, on the full sets.

A group of copies is never expanded into all its pairs:

* texts with the same set are one class, found by a fingerprint of the whole set;
* in rounds, each class is compared with one other of its band buckets that is not in its
  component yet, until the rounds bring little more;
* the buckets that still hold several components are compared completely across components, in
  blocks of bounded size by signature, so that only survivors become rows.

So a link is only left out where its two ends are already in one component.

Components come from repeated passing of the smallest id along links and pointers.

Nulls and ties: a null text, or one without words, has an empty set and stands alone, as does a
row whose id is null (its component is null; it is kept). A text with fewer words than a
shingle is one shingle. Rows that share an id are one document with several texts; each row is
returned, with its own set size and the shared component. Intermediate results are written
to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerframe.llm.common import lean, words
from answerframe.session import written

PAIR = "a binary, b binary"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0x2545F4914F6CDD1D], dtype=np.uint64)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    split = words(text)
    if not split:
        return np.zeros(0, dtype=np.uint64)
    if len(split) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(split), seed=len(split))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, split), dtype=np.uint64, count=len(split))
    n = len(h) - size + 1
    mixed = sum((h[k : k + n] * _ODD[k % 5] * np.uint64(2 * (k // 5) + 1) for k in range(1, size)), h[:n] * _ODD[0])
    mixed ^= mixed >> np.uint64(32)
    mixed *= _ODD[1]
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


class Signer:
    """MinHash signatures of 32-bit values; a family of multiply-add functions of both halves of a hash."""

    def __init__(self, n: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.low, self.high = (rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1) for _ in range(2))

    def sign(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(self.low), 0xFFFFFFFF, dtype=np.uint32)
        for k in range(0, len(hashes), 512):
            part = hashes[k : k + 512]
            low, high = part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32)
            values = low[None, :] * self.low[:, None]
            values += high[None, :] * self.high[:, None]
            np.minimum(out, values.min(axis=1), out=out)
        return out


def least_matches(n_hashes: int, batch: int, threshold: float, miss: float) -> np.ndarray:
    """For each number of batches compared, the fewest matches at which a pair may still be similar.

    With m matches of n and a uniform prior the similarity is Beta(m + 1, n - m + 1). Bytes that
    match by chance (1 in 256) only make a pair live longer.
    """
    grid = (np.arange(2000) + 0.5) / 2000
    out = []
    for n in range(batch, n_hashes + 1, batch):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(grid) + (n - m) * np.log1p(-grid)
        density = np.exp(log - log.max(axis=1, keepdims=True))
        tail = density[:, grid >= threshold].sum(axis=1) / density.sum(axis=1)
        out.append(int(np.argmax(tail >= miss)))
    return np.array(out)


def sequential(a: np.ndarray, b: np.ndarray, least: np.ndarray, batch: int) -> np.ndarray:
    """Places of the signature pairs that no batch has dropped."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for k, fewest in enumerate(least):
        at = slice(k * batch, (k + 1) * batch)
        matches[alive] += (a[alive, at] == b[alive, at]).sum(axis=1)
        alive = alive[matches[alive] >= fewest]
    return alive


def _signatures(column: pd.Series, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), -1)


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id of ``a, b``: the smallest id that can be reached.

    Each round every id takes the smallest label of its neighbours, and then the label of its label.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        told = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("heard"))
        heard = labels.join(told, labels["id"] == told["a"], "left").select(
            "id", F.col("component").alias("was"), F.least("component", F.coalesce("heard", "component")).alias("component")
        )
        # The label is an id itself; its own label is at most as large.
        pointed = heard.select(F.col("id").alias("via"), F.col("component").alias("further"))
        jumped = heard.join(pointed, heard["component"] == pointed["via"], "left").select(
            "id", "was", F.least("component", F.coalesce("further", "component")).alias("component")
        )
        fresh = written(jumped, "labels")
        changed = fresh.filter("component <> was").limit(1).count()
        labels = fresh.select("id", "component")
        if not changed:
            return labels


def _verified(pairs: DataFrame, texts: DataFrame, threshold: int, size: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar: 100 * common >= threshold * union."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["text_a"], batch["text_b"], strict=True):
                p, q = shingle_set(x, size), shingle_set(y, size)
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * common >= threshold * (len(p) + len(q) - common))
            yield batch.loc[keep, ["a", "b"]]

    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInPandas(lean(check), PAIR)


def near_duplicates(
    docs: DataFrame, threshold: int = 75, size: int = 5, bands: int = 36, rows: int = 5, batch: int = 40, miss: float = 1e-6,
    rounds: int = 6, block: int = 1000, sketch: int = 720,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``doc_id, text``; ``threshold`` in hundredths.

    ``bands * rows`` hashes find candidates; ``sketch`` further ones, one byte each, verify them.
    """
    signer, least = Signer(bands * rows), least_matches(sketch, batch, threshold / 100, miss)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            sets = [shingle_set(t if isinstance(t, str) else None, size) for t in frame["text"]]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "n_shingles": [len(s) for s in sets], "node": [_mark(s) for s in sets],
                "signature": [signer.sign(s).tobytes() if len(s) else None for s in sets],
            })

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # An id passes as text: beside a null, pandas would make a float of it.
    signed = own.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(lean(sign), "doc_id string, n_shingles long, node binary, signature binary")
    signed = written(signed.withColumn("doc_id", F.col("doc_id").cast("bigint")), "signed")
    alive = signed.filter("node is not null and doc_id is not null")
    # A node is a set of shingles, named by its fingerprint; ``rep`` is the smallest id that has it.
    classes = written(alive.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")), "classes")
    keyed = written(classes.select("node", "signature").mapInPandas(lean(_bands(bands, rows)), "node binary, key long"), "bands")
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    buckets = written(keyed.join(shared.select("key"), "key"), "buckets")
    texts = written(_texts(own, classes, buckets, size, Signer(sketch, seed=12)), "texts")
    signatures = texts.select("node", F.col("sketch").alias("signature"))

    nodes = classes.select("node")
    labels = nodes.select("node", F.col("node").alias("component"))
    links, tried = None, None
    for turn in range(rounds):
        pairs = _round(buckets, labels, turn)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        n = pairs.count()
        if not n:
            break
        found = written(_verified(_survivors(pairs, signatures, least, batch), texts, threshold, size), "found")
        tried = pairs if tried is None else tried.union(pairs)
        links = found if links is None else links.union(found)
        labels = _labels(links, nodes)
        if found.count() < 0.05 * n:
            break
    rest = _blocks(buckets, labels, signatures, least, batch, block)
    if tried is not None:
        rest = rest.join(tried, ["a", "b"], "left_anti")
    found = written(_verified(written(rest, "rest"), texts, threshold, size), "found")
    links = found if links is None else links.union(found)

    # An id with several texts ties their classes together.
    member = alive.select("doc_id", "node").distinct()
    several = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("doc_id", "a")
    tied = member.join(several, "doc_id").select("a", F.col("node").alias("b"))
    final = classes.select("node", "rep").join(_labels(links.union(tied), nodes), "node")
    smallest = final.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = final.join(smallest, "component").select("node", "component_id")
    # A large class is joined by its node; the adaptive plan splits it.
    out = signed.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    # Rows without words of an id that has words elsewhere belong to that id's component.
    blank = out.filter("component_id is null and doc_id is not null").select("doc_id").distinct()
    elsewhere = out.filter("component_id is not null").join(blank, "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("elsewhere"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "elsewhere", "doc_id"))
    return out.join(elsewhere, "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def _mark(hashes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            signatures = _signatures(frame["signature"]).astype(np.uint64)
            keys = np.zeros((len(frame), bands), dtype=np.uint64)
            for b in range(bands):
                for r in range(rows):
                    keys[:, b] = (keys[:, b] ^ signatures[:, b * rows + r]) * _ODD[r % 5]
                    keys[:, b] ^= keys[:, b] >> np.uint64(31)
                keys[:, b] = (keys[:, b] + np.uint64(b)) * _ODD[4]
            yield pd.DataFrame({"node": np.repeat(frame["node"].to_numpy(), bands), "key": keys.reshape(-1).astype(np.int64)})

    return run


def _texts(own: DataFrame, classes: DataFrame, buckets: DataFrame, size: int, signer: Signer) -> DataFrame:
    """``node, text, sketch`` of the classes that share a bucket with another: the text of the smallest id."""
    needed = classes.select("node", F.col("rep").alias("doc_id")).join(buckets.select("node").distinct(), "node")

    def own_set(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # An id may have several texts; only the one with the class's set is its text.
        for frame in batches:
            rows = []
            for node, text in zip(frame["node"], frame["text"], strict=True):
                own = shingle_set(text, size)
                if _mark(own) == bytes(node):
                    rows.append((node, text, (signer.sign(own) >> np.uint32(4)).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["node", "text", "sketch"])

    found = own.filter("text is not null").join(needed, "doc_id").select("node", "text").mapInPandas(lean(own_set), "node binary, text string, sketch binary")
    return found.groupBy("node").agg(F.min("text").alias("text"), F.first("sketch").alias("sketch"))


def _labels(links: DataFrame, nodes: DataFrame) -> DataFrame:
    found = components(links).select(F.col("id").alias("node"), F.col("component").alias("of"))
    return written(nodes.join(found, "node", "left").select("node", F.coalesce("of", "node").alias("component")), "labels")


def _open_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, node, component`` of the buckets that hold several components."""
    labelled = buckets.join(labels, "node").select("key", "node", "component")
    several = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    return written(labelled.join(several.select("key"), "key"), "open")


def _round(buckets: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """For each class one other of its buckets, in another component.

    In the first turn that with the most bucket mates: the text that many others are edits of,
    whereas two edits of it may be less similar than either is to it. Later the first by a hash of the turn.
    """
    entries = _open_buckets(buckets, labels)
    order = F.xxhash64("node", F.lit(turn))
    if not turn:
        sizes = entries.groupBy("key").agg(F.count("*").alias("n"))
        mates = entries.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("mates"))
        entries, order = entries.join(mates, "node"), -F.col("mates")
    leaders = entries.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "component")).alias("l"))
    met = entries.join(leaders, "key").filter(F.col("component") != F.col("l.component"))
    one = met.groupBy("node").agg(F.min("l").alias("l"))
    return one.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct()


def _survivors(pairs: DataFrame, signatures: DataFrame, least: np.ndarray, batch: int) -> DataFrame:
    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                yield frame.iloc[sequential(_signatures(frame["s"], np.uint8), _signatures(frame["t"], np.uint8), least, batch)][["a", "b"]]

    s = signatures.select(F.col("node").alias("a"), F.col("signature").alias("s"))
    t = signatures.select(F.col("node").alias("b"), F.col("signature").alias("t"))
    return pairs.join(s, "a").join(t, "b").mapInPandas(lean(prune), PAIR)


def _blocks(buckets: DataFrame, labels: DataFrame, signatures: DataFrame, least: np.ndarray, batch: int, block: int) -> DataFrame:
    """Surviving pairs of different components from the buckets that still hold several.

    Of each bucket, all classes outside its largest component meet all others. Both sides are
    dealt in blocks by a hash, so a task holds two blocks however large the bucket is.
    """
    entries = _open_buckets(buckets, labels)
    counts = entries.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = counts.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("l"))
    parts = lambda n: F.ceil(n / block).cast("int")
    shape = largest.select("key", F.col("l.component").alias("main"), parts(F.col("all")).alias("parts"), parts(F.col("all") - F.col("l.n")).alias("asks"))
    # A pair may meet in several buckets; it counts in the first, so every class brings its keys (one for each band at most).
    keys = entries.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    dealt = entries.join(shape, "key").join(signatures.join(keys, "node"), "node")
    right = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
    left = dealt.filter("component <> main").withColumn("ask", F.pmod(F.xxhash64("node"), F.col("asks")).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[bytes, bytes]] = []
        if len(x) and len(y):
            p, q = _signatures(x["signature"], np.uint8), _signatures(y["signature"], np.uint8)
            mine, theirs = ([bytes(n) for n in f["node"]] for f in (x, y))
            of = np.array([bytes(c) for c in y["component"]], dtype=object)
            here, keys, others = int(x["key"].iloc[0]), [set(k) for k in x["keys"]], y["keys"].tolist()
            for i, component in enumerate(x["component"]):
                other = np.flatnonzero(of != bytes(component))
                hit = other[sequential(np.broadcast_to(p[i], (len(other), p.shape[1])), q[other], least, batch)]
                hit = [j for j in hit if next(k for k in others[j] if k in keys[i]) == here]
                found += [(min(mine[i], theirs[j]), max(mine[i], theirs[j])) for j in hit]
        return pd.DataFrame(found, columns=["a", "b"])

    key, columns = ["key", "part", "ask"], ["node", "component", "signature", "keys"]
    # Both sides come from the same rows; fresh names keep their columns apart.
    theirs = right.select(*[F.col(c).alias(f"other_{c}") for c in (*key, *columns)])
    theirs = theirs.select(*[F.col(f"other_{c}").alias(c) for c in (*key, *columns)])
    return left.select(*key, *columns).groupBy(*key).cogroup(theirs.groupBy(*key)).applyInPandas(meet, PAIR).distinct()
