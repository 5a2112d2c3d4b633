"""Benchmark decontamination: every passage of the training texts is a query to an index of test items.

The items are the small side: an inverted index with BM25 impacts, in which each item's impacts
are scaled so that the item itself scores 1. Every passage (four pieces of a text
in a row, of which three are longer than the longest item) is run against it by block-max WAND, which
retrieves all items at or above ``retrieve``. An item of which ``overlap`` of the shingles could
be met at a lower score is raised by a factor of its own, so that no such passage is missed.
Retrieved pairs are verified on five-word shingles of the text around the passage: a pair is a
leak if it holds at least ``overlap`` of the item's shingles, wherever the others were lost. The shares of the
shingles of the question and of the answer (those that reach into the last quarter of the words) are reported.
A passage without any shingle of any item, found by one lookup of hashes for all words of a batch, can share
nothing, so it is left out before the search; that drops no leak.

Items are indexed in blocks of about ``block_items`` (chosen by a hash), each broadcast for one
pass over the texts, so what is broadcast stays bounded however many items there are. Document
frequencies and the average length are of all items. Texts are read whole and never shuffled; a lost task is redone.

Nulls and ties: null or empty texts and items leak nothing. An item shorter than five words is
one shingle of all its words. Words are compared in lower case without ASCII
punctuation. Repeated items and documents are each reported; a pair is reported once for each
row of the documents. A null id is kept as null.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from answerframe.llm.common import blocks, lean

SHINGLE = 5
_BLANKS = bytes(b for b in range(128) if not chr(b).isalnum())
_TABLE = bytes.maketrans(_BLANKS, b" " * len(_BLANKS))


def plain_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_TABLE).split() if text else []


def shingles(words: list[bytes], size: int = SHINGLE) -> set[bytes]:
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


@dataclass
class Index:
    """``terms`` numbers the words. Postings of a term: ordinals of items and impacts, both in item order."""

    ids: list
    words: list[list[bytes]]
    terms: dict[bytes, int]
    items: list[np.ndarray]
    impacts: list[np.ndarray]
    most: np.ndarray  # the largest impact of each term
    block_most: list[list[float]]
    group_most: np.ndarray  # terms x groups of items, the largest impact in each
    window: int
    raised: list[float]  # the factor of each item's impacts
    grams: dict[int, np.ndarray]  # by size, hashes of the shingles of the items' words, sorted
    block: int = 16
    parts: dict = field(default_factory=dict)

    def question_and_answer(self, item: int) -> tuple[int, set[bytes], set[bytes]]:
        """Words in a shingle, shingles within the question and those that reach into the answer."""
        if item not in self.parts:
            words = self.words[item]
            size, cut = min(SHINGLE, len(words)), -max(1, len(words) // 4)
            question = shingles(words[:cut], size)
            self.parts[item] = (size, question, shingles(words, size) - question)
        return self.parts[item]


def least_score(words: list[bytes], impact: dict[bytes, float], overlap: float) -> float:
    """A score that any text with ``overlap`` of an item's shingles reaches.

    Each lost place costs a lost shingle at least; a word is lost with all of its places. Of distinct
    shingles each may stand for several places, so all of their places count as lost.
    """
    size = min(SHINGLE, len(words))
    times = Counter(b" ".join(words[i : i + size]) for i in range(len(words) - size + 1))
    lost = len(times) - math.ceil(overlap * len(times) - 1e-9)
    places = sum(n for _, n in times.most_common(lost))
    own = Counter(words)
    heavy = sorted((impact[w] / own[w] for w in words), reverse=True)
    return max(1e-6, 1.0 - sum(heavy[:places]) - 1e-9)


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def gram_hashes(term: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` numbers in a row. Different rows may share one, which only costs a search."""
    if len(term) < size:
        return np.zeros(0, dtype=np.uint64)
    numbers = term.astype(np.uint64) + np.uint64(1)
    n = len(term) - size + 1
    out = numbers[:n] * _FACTORS[0]
    for k in range(1, size):
        out = (out ^ (out >> np.uint64(29))) + numbers[k : k + n] * _FACTORS[k]
    return out


def build(
    ids: list, texts: list[str | None], frequency: dict[bytes, int], n_items: int, k1: float = 0.9, b: float = 0.4, groups: int = 64,
    retrieve: float = 0.0, overlap: float = 1.0, average: float | None = None,
) -> Index:
    """An index of some items. ``frequency``, ``n_items`` and ``average`` (words an item) are of all items."""
    # Items of about the same length are neighbours, since their impacts are of about the same size.
    order = sorted(range(len(ids)), key=lambda i: len(texts[i] or ""))
    ids, words = [ids[i] for i in order], [plain_words(texts[i]) for i in order]
    average = average or sum(map(len, words)) / max(1, len(words)) or 1.0
    terms: dict[bytes, int] = {}
    postings: list[list[tuple[int, float]]] = []
    raised = []
    for item, ws in enumerate(words):
        raw = {}
        for w, tf in Counter(ws).items():
            df = frequency.get(w, 1)
            idf = math.log(1 + (n_items - df + 0.5) / (df + 0.5))
            raw[w] = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(ws) / average))
        total = sum(raw.values())
        raised.append(max(1.0, retrieve / least_score(ws, {w: x / total for w, x in raw.items()}, overlap)) if ws else 1.0)
        for w, x in raw.items():
            if w not in terms:
                terms[w] = len(terms)
                postings.append([])
            postings[terms[w]].append((item, x / total * raised[item]))
    impacts = [np.array([x for _, x in p]) for p in postings]
    hashed: dict[int, list[np.ndarray]] = {}
    for ws in words:
        if ws:
            size = min(SHINGLE, len(ws))
            hashed.setdefault(size, []).append(gram_hashes(np.array([terms[w] for w in ws]), size))
    group_most = np.zeros((len(terms), min(groups, max(1, len(ids)))), dtype=np.float32)
    for t, p in enumerate(postings):
        for i, x in p:
            g = i * group_most.shape[1] // len(ids)
            group_most[t, g] = max(group_most[t, g], x)
    return Index(
        ids, words, terms, [np.array([i for i, _ in p]) for p in postings], impacts, np.array([x.max() for x in impacts] or [0.0]),
        [[float(x[k : k + 16].max()) for k in range(0, len(x), 16)] for x in impacts], group_most, max(64, max(map(len, words), default=0) * 9 // 8), raised,
        {size: np.unique(np.concatenate(found)) for size, found in hashed.items()},
    )


def block_max_wand(index: Index, query: list[int], least: float) -> list[tuple[int, float]]:
    """All items whose summed impacts over the distinct terms of ``query`` reach ``least``.

    Cursors over the terms' postings are kept in item order. The pivot is the first at which the
    largest impacts could reach ``least``; the maxima of the postings' blocks then decide
    whether the pivot item is scored or its blocks are left as a whole.
    """
    end, size = 1 << 60, index.block
    # [item at the cursor, cursor, term]
    cursors = [[int(index.items[t][0]), 0, t] for t in query]
    found = []

    def seek(c: list, item: int) -> None:
        own = index.items[c[2]]
        c[1] = int(np.searchsorted(own, item))
        c[0] = int(own[c[1]]) if c[1] < len(own) else end

    while cursors:
        cursors.sort()
        while cursors and cursors[-1][0] == end:
            cursors.pop()
        bound, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            bound += index.most[c[2]]
            if bound >= least:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        # The block of each list that would hold the item; next: where all these blocks have ended.
        tight, leave = 0.0, end
        for c in cursors[: pivot + 1]:
            own = index.items[c[2]]
            at = int(np.searchsorted(own, item))
            if at < len(own):
                tight += index.block_most[c[2]][at // size]
                last = (at // size + 1) * size - 1
                leave = min(leave, (int(own[last]) if last < len(own) else end - 1) + 1)
        if tight < least:
            if pivot + 1 < len(cursors):
                leave = min(leave, cursors[pivot + 1][0])
            leave = max(leave, item + 1)
            for c in cursors[: pivot + 1]:
                if c[0] < leave:
                    seek(c, leave)
            continue
        score = 0.0
        for c in cursors[: pivot + 1]:
            if c[0] < item:
                seek(c, item)
            if c[0] == item:
                score += float(index.impacts[c[2]][c[1]])
        if score >= least:
            found.append((item, score))
        for c in cursors[: pivot + 1]:
            if c[0] == item:
                seek(c, item + 1)
    return found


def search(texts: list[str | None], index: Index, retrieve: float, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
    """``text, item, score, question overlap, answer overlap`` of the leaks in some texts."""
    split = [plain_words(t) for t in texts]
    sizes = np.array([len(ws) for ws in split])
    get = index.terms.get
    term = np.fromiter((get(w, -1) for ws in split for w in ws), dtype=np.int64, count=int(sizes.sum()))
    # Pieces of windows are numbered through all texts; those of one text follow each other.
    piece = -(-index.window // 3)
    per_text = -(-sizes // piece)
    first_piece = np.cumsum(per_text) - per_text
    starts = np.cumsum(sizes) - sizes
    at = np.flatnonzero(term >= 0)
    owner = np.repeat(np.arange(len(texts)), sizes)[at]
    pieces = first_piece[owner] + (at - starts[owner]) // piece
    pairs = np.unique(pieces * len(index.terms) + term[at]) if len(at) else np.zeros(0, dtype=np.int64)
    pair_piece, pair_term = pairs // max(1, len(index.terms)), pairs % max(1, len(index.terms))
    n_pieces = int(per_text.sum())
    text_of = np.repeat(np.arange(len(texts)), per_text)
    # A window is a piece and its three successors, as far as they are in the same text. If no group of items can
    # reach the threshold with all of the window's terms, no pivot exists in any, and nothing is searched.
    ends = np.minimum(np.arange(n_pieces) + 4, (first_piece + per_text)[text_of])
    bound = np.zeros((n_pieces, index.group_most.shape[1]), dtype=np.float32)
    filled, begin = np.unique(pair_piece, return_index=True)
    for k in range(0, len(filled), 4096):
        upto = begin[k + 4096] if k + 4096 < len(filled) else len(pairs)
        bound[filled[k : k + 4096]] = np.add.reduceat(index.group_most[pair_term[begin[k] : upto]], begin[k : k + 4096] - begin[k], axis=0)
    total = bound.copy()
    for k in range(1, 4):
        inside = np.flatnonzero(ends > np.arange(n_pieces) + k)
        total[inside] += bound[inside + k]
    whole = total.max(axis=1, initial=0.0) + 1e-6
    # A leak shares a shingle with the text that is looked at around the window, so windows without any there are left out.
    all_pieces = np.repeat(first_piece, sizes) + (np.arange(len(term)) - np.repeat(starts, sizes)) // piece
    shared = np.zeros(n_pieces + 1, dtype=np.int64)
    for size, known in index.grams.items():
        grams = gram_hashes(term, size)
        place = np.searchsorted(known, grams)
        hit = known[np.minimum(place, len(known) - 1)] == grams
        shared[1:] += np.bincount(all_pieces[: len(grams)][hit], minlength=n_pieces)
    shared = np.cumsum(shared)
    at_piece = np.arange(n_pieces)
    whole[shared[np.minimum(at_piece + 6, n_pieces)] == shared[np.maximum(at_piece - 2, 0)]] = -1.0
    edges = np.searchsorted(pair_piece, np.arange(n_pieces + 1))
    done: set[tuple[int, int, int]] = set()
    for h in np.flatnonzero(whole >= retrieve):
        query = np.unique(pair_term[edges[h] : edges[ends[h]]])
        if index.group_most[query].sum(axis=0).max(initial=0.0) + 1e-6 < retrieve:
            continue
        t = int(text_of[h])
        place = (h - first_piece[t]) * piece
        for item, score in block_max_wand(index, query.tolist(), retrieve):
            size, question, answer = index.question_and_answer(item)
            text = split[t][max(0, place - 2 * piece) : place + 6 * piece]
            near = shingles(text, size)
            q, a = (len(x & near) / len(x) if x else 1.0 for x in (question, answer))
            held = len(question & near) + len(answer & near)
            if held >= overlap * (len(question) + len(answer)) - 1e-9 and (t, item) not in done:
                done.add((t, item))
                yield t, item, score / index.raised[item], q, a


def leaks(
    docs: DataFrame, items: DataFrame, retrieve: float = 0.5, overlap: float = 0.75, block_items: int = 20_000, block_chars: int = 2_000_000
) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap``: the items that leak into each document.

    ``docs`` has ``doc_id, text`` and ``items`` has ``item_id, text``.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text").filter("text is not null")
    kept = items.filter("text is not null").select("item_id", "text", F.xxhash64("item_id", "text").alias("spread"))
    n_items = kept.count()
    n_blocks = -(-n_items // block_items)
    blanks = "[" + "".join(f"\\x{b:02x}" for b in _BLANKS) + "]+"
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    numbered = kept.withColumn("block", F.pmod("spread", F.lit(max(1, n_blocks))))
    words = numbered.select("block", F.explode(F.array_distinct(F.split(lower, blanks))).alias("word")).filter("word <> ''")
    frequency = words.groupBy("word").agg(F.count("*").alias("n"))
    schema = T.StructType([
        docs.schema["doc_id"], items.schema["item_id"], *[T.StructField(c, T.DoubleType()) for c in ("score", "question_overlap", "answer_overlap")]
    ])
    listed = F.filter(F.split(lower, blanks), lambda w: w != "")
    average = kept.agg(F.avg(F.size(listed)).alias("n")).first()["n"] or 1.0
    item_type = to_arrow_type(schema["item_id"].dataType)
    out = spark.createDataFrame([], schema)
    for k in range(n_blocks):
        own = numbered.filter(F.col("block") == k).orderBy("spread", "item_id").select("item_id", "text").collect()
        known = words.filter(F.col("block") == k).select("word").distinct().join(frequency, "word").collect()
        table = {r["word"].encode(): r["n"] for r in known}
        index = build([r["item_id"] for r in own], [r["text"] for r in own], table, n_items, retrieve=retrieve, overlap=overlap, average=average)
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                whole = batch.column(1).to_pylist()
                for part in blocks(whole, block_chars):
                    hits = list(search(whole[part], index, retrieve, overlap))
                    if hits:
                        ids = batch.column(0).take(pa.array([part.start + h[0] for h in hits]))
                        found = pa.array([index.ids[h[1]] for h in hits], item_type)
                        shares = [pa.array([h[c] for h in hits], pa.float64()) for c in (2, 3, 4)]
                        yield pa.RecordBatch.from_arrays([ids, found, *shares], schema.fieldNames())

        out = out.unionAll(texts.mapInArrow(lean(run), schema))
    return out
