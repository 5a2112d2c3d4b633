"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of neighbouring pairs and of pairs
with one or two words between. Training follows the proximal form with a learning rate for
each coordinate and L1 sparsity, over a bounded sample of labelled texts (``max_rows``,
chosen by a hash of the id); most weights end at exactly zero, so what is broadcast is a short
list of buckets and weights. Scoring is a map over whole texts in blocks of bounded size.

Nulls and ties: a null text has no features and gets the base rate, as an empty one does. Rows
with a null label or null text are not learned from; without any, every score is 0. A label
table with several rows for an id counts the largest. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerframe.llm.common import blocks, map_rows, share_of, words

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0x2545F4914F6CDD1D], dtype=np.uint64)
_EDGES = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


@dataclass
class Model:
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    bias: float
    bits: int


def _features(hashes: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and the text of each, for word hashes of texts laid end to end."""
    shift = np.uint64(64 - bits)
    made, owners = [(hashes * _ODD[0]) >> shift], [doc]
    for gap in (1, 2, 3):
        same = doc[gap:] == doc[:-gap]
        pair = (hashes[:-gap] * _ODD[1] + hashes[gap:] * _ODD[1 + gap]) * _ODD[0]
        made.append((pair ^ (pair >> np.uint64(31)))[same] * _ODD[4] >> shift)
        owners.append(doc[gap:][same])
    return np.concatenate(made).astype(np.int64), np.concatenate(owners)


def _hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    split = [[w for w in (x.strip(_EDGES) for x in words(t)) if w] for t in texts]
    flat = [w for ws in split for w in ws]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, flat), dtype=np.uint64, count=len(flat))
    return hashes, np.repeat(np.arange(len(texts)), [len(ws) for ws in split])


def ftrl(
    rows: list[np.ndarray], labels: np.ndarray, bits: int, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0,
    least_rows: int = 6,
) -> Model:
    """Rows are arrays of distinct buckets; they are taken in the given order, ``epochs`` times.

    Buckets of fewer than ``least_rows`` rows are left out: they cannot outweigh ``l1`` but by memorizing.
    """
    seen = np.zeros(1 << bits, dtype=np.int32)
    for at in rows:
        seen[at] += 1
    rows = [at[seen[at] >= least_rows] for at in rows]
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    base = float(np.clip(labels.mean(), 1e-4, 1 - 1e-4)) if len(labels) else 1e-9
    bias, bias_n = np.log(base / (1 - base)), 1.0
    for _ in range(epochs if 0 < labels.sum() < len(labels) else 0):
        for at, y in zip(rows, labels, strict=True):
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = p - y
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
            bias -= 0.05 * g / np.sqrt(bias_n)
            bias_n += g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    at = np.flatnonzero(w)
    return Model(at, w[at].astype(np.float32), float(bias), bits)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, bits: int = 22, **ftrl_options: float) -> Model:
    """Learn from ``doc_id, text`` and ``doc_id, toxic``, at most about ``max_rows`` of the labelled rows.

    What reaches the driver is the sample's buckets, four bytes for each feature.
    """
    once = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = once.filter(share_of(max_rows, once, "doc_id"))
    sample = docs.filter("text is not null").select("doc_id", "text").join(chosen, "doc_id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for text in batch["text"]:
                hashes, doc = _hashed([text])
                made.append(np.unique(_features(hashes, doc, bits)[0]).astype(np.int32).tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "buckets": made})

    # Repeated rows of an id would take the sample over its bound only by their number.
    rows = sample.mapInPandas(features, "doc_id long, toxic int, buckets binary").orderBy(F.xxhash64("doc_id"), "doc_id", "buckets")
    got = rows.limit(2 * max_rows).toPandas()
    arrays = [np.frombuffer(b, dtype=np.int32) for b in got["buckets"]]
    return ftrl(arrays, got["toxic"].to_numpy(dtype=np.float64), bits, **ftrl_options)


def score(docs: DataFrame, model: Model, block_chars: int = 2_000_000) -> DataFrame:
    """``docs`` with ``toxic_score`` from 0 to 1; an own column of that name is replaced."""
    docs = docs.drop("toxic_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        dense = np.zeros(1 << m.bits, dtype=np.float32)
        dense[m.buckets] = m.weights
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            total = np.full(len(texts), m.bias)
            for part in blocks(texts, block_chars):
                hashes, doc = _hashed(texts[part])
                buckets, owners = _features(hashes, doc, m.bits)
                weighing = np.flatnonzero(dense[buckets])
                # Each bucket counts once for a text, as in training.
                pairs = np.unique((owners[weighing] << m.bits) | buckets[weighing])
                size = part.stop - part.start
                total[part] += np.bincount(pairs >> m.bits, weights=dense[pairs & ((1 << m.bits) - 1)], minlength=size)
            batch = batch.copy()
            batch["toxic_score"] = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield batch

    return map_rows(docs, run, [T.StructField("toxic_score", T.DoubleType())])
