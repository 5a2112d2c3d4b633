"""Language of texts, and of spans within mixed texts.

Every word is scored under each learned language by its letter trigrams and as a whole; the
scripts of its letters narrow the languages down first. Viterbi over a text's words, with a
fixed penalty for each switch, labels spans; the language with the most letters is the text's.

Training counts grams over a bounded sample of labelled texts (``max_rows``, chosen by a hash
of the id); the counts are a fixed table of ``2 ** bits`` rows for each language, so the model
stays small however large the corpus is. Prediction is a map over whole texts, in blocks of
bounded size, without a shuffle.

Nulls and ties: a null text, or one without a letter, is ``und`` with score 0 and no spans,
as is every text if nothing could be learned. A text whose script belongs to no learned
language still gets the best learned one. Ties go to the language that sorts first. Rows
with null text or null language are not learned from. Repeated rows are treated alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerframe.llm.common import blocks, lean, map_rows, share_of

UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")

# First code points of the scripts' main ranges; the rest of a range is of the script before.
_SCRIPT_STARTS = {
    0x0000: "none", 0x0041: "Latin", 0x0370: "Greek", 0x0400: "Cyrillic", 0x0530: "Armenian", 0x0590: "Hebrew",
    0x0600: "Arabic", 0x0900: "Devanagari", 0x0980: "Bengali", 0x0A00: "Gurmukhi", 0x0A80: "Gujarati", 0x0B00: "Oriya",
    0x0B80: "Tamil", 0x0C00: "Telugu", 0x0C80: "Kannada", 0x0D00: "Malayalam", 0x0D80: "Sinhala", 0x0E00: "Thai",
    0x0E80: "Lao", 0x0F00: "Tibetan", 0x1000: "Myanmar", 0x10A0: "Georgian", 0x1100: "Hangul", 0x1200: "Ethiopic",
    0x1380: "other", 0x1780: "Khmer", 0x1800: "other", 0x1E00: "Latin", 0x1F00: "Greek", 0x2000: "none", 0x3040: "Kana",
    0x3100: "Han", 0xAC00: "Hangul", 0xD7B0: "other", 0xF900: "Han", 0xFB00: "Latin", 0xFB1D: "Hebrew", 0xFB50: "Arabic",
    0xFF21: "Latin", 0xFF66: "Kana", 0xFFA0: "Hangul", 0x10000: "other", 0x20000: "Han",
}
_STARTS = np.array(list(_SCRIPT_STARTS), dtype=np.uint32)
SCRIPTS = sorted(set(_SCRIPT_STARTS.values()))
_SCRIPT_OF = np.array([SCRIPTS.index(s) for s in _SCRIPT_STARTS.values()])


@dataclass
class Model:
    """``scores``: log-probabilities, a row for each gram bucket and a column for each language."""

    languages: list[str]
    scores: np.ndarray
    scripts: np.ndarray  # languages x scripts, True where the language uses the script
    bits: int
    penalty: float


def _codes(words: list[str]) -> np.ndarray:
    """Code points of the words with a line break before, between and after."""
    return np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words' grams, the word each belongs to, and each word's script."""
    codes = _codes(words)
    breaks = codes == 10
    word = np.cumsum(breaks) - 1
    c = codes.astype(np.uint64)
    mixed = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    inside = ~breaks[1:-1]
    # The whole word as one more gram: a sum over its letters and their places.
    starts = np.flatnonzero(breaks)[:-1]
    place = np.arange(len(codes) - 1) - np.repeat(starts, np.diff(np.append(starts, len(codes) - 1)))
    powers = (place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0x2545F4914F6CDD1D)
    whole = np.add.reduceat(c[:-1] * powers * powers, starts)
    values = np.concatenate([mixed[inside], whole])
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    buckets = (values >> np.uint64(64 - bits)).astype(np.int64)
    owners = np.concatenate([word[1:-1][inside], np.arange(len(words))])
    first = codes[starts + 1]
    return buckets, owners, _SCRIPT_OF[np.searchsorted(_STARTS, first, side="right") - 1]


def train(docs: DataFrame, max_rows: int = 20_000, bits: int = 17, penalty: float = 8.0, smoothing: float = 0.5) -> Model:
    """Learn from ``doc_id, text, lang``; at most about ``max_rows`` of the labelled rows."""
    labelled = docs.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    sample = labelled.filter(share_of(max_rows, labelled, "doc_id"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                words = _WORD.findall(text.lower())
                if words:
                    buckets, _, script = _grams(words, bits)
                    grams.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                    scripts.setdefault(lang, np.zeros(len(SCRIPTS), dtype=np.int64))
                    grams[lang] += np.bincount(buckets, minlength=1 << bits)
                    scripts[lang] += np.bincount(script, minlength=len(SCRIPTS))
        for lang in grams:
            for kind, counts in (("gram", grams[lang]), ("script", scripts[lang])):
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"lang": lang, "kind": kind, "bucket": at, "n": counts[at]})

    # Each partition gives a row for each bucket it saw; the sum has at most a table's rows for each language.
    counted = sample.mapInPandas(lean(count), "lang string, kind string, bucket long, n long")
    summed = counted.groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (lang, kind), own in batch.groupby(["lang", "kind"], sort=False):
                packed = (own[c].to_numpy(dtype=np.int64).tobytes() for c in ("bucket", "n"))
                yield pd.DataFrame([(lang, kind, *packed)], columns=["lang", "kind", "bucket", "n"])

    # The driver gets a few long rows of numbers instead of one row object for each count.
    total = summed.mapInPandas(lean(pack), "lang string, kind string, bucket binary, n binary").toPandas()
    languages = sorted(total["lang"].unique())
    table = np.full((1 << bits, len(languages)), smoothing)
    scripts = np.zeros((len(languages), len(SCRIPTS)))
    for lang, kind, bucket, n in total.itertuples(index=False):
        at, counts, i = np.frombuffer(bucket, dtype=np.int64), np.frombuffer(n, dtype=np.int64), languages.index(lang)
        if kind == "gram":
            table[at, i] += counts
        else:
            scripts[i, at] += counts
    scores = np.log(table / table.sum(axis=0)) if languages else table
    used = scripts >= 0.01 * scripts.sum(axis=1, keepdims=True) if languages else scripts > 0
    return Model(languages, scores.astype(np.float32), used, bits, penalty)


class _Scorer:
    """Scores of words, kept for the words met so far (at most ``most``)."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages)), dtype=np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """A row number of ``table`` for each word; -1 for what has no letter."""
        if len(self.ids) > self.most:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.ids]
        if new:
            buckets, owners, script = _grams(new, self.model.bits)
            scores = np.stack(
                [np.bincount(owners, weights=self.model.scores[buckets, i], minlength=len(new)) for i in range(len(self.model.languages))], axis=1
            )
            # Only languages of the word's script stay; a script that none uses narrows nothing.
            allowed = self.model.scripts[:, script].T
            allowed |= ~allowed.any(axis=1, keepdims=True)
            scores = np.where(allowed, scores - scores.max(axis=1, keepdims=True), -1000.0)
            at = len(self.table)
            self.table = np.concatenate([self.table, scores.astype(np.float32)])
            for i, w in enumerate(new):
                self.ids[w] = at + i if any(c.isalpha() for c in w) else -1
        return np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words))


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best labels of sequences laid end to end in ``scores``, all stepped through together."""
    n_states = scores.shape[1]
    if not scores.size:
        return np.zeros(len(scores), dtype=np.int16)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    best = np.zeros(len(scores), dtype=np.int16)
    switched = np.zeros(scores.shape, dtype=bool)
    steps = int(sizes[0]) if len(sizes) else 0
    # How many sequences are longer than t.
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")
    value = np.zeros((len(sizes), n_states), dtype=np.float64)
    for t in range(steps):
        k = active[t]
        rows, now = starts[:k] + t, value[:k]
        if t:
            top = now.max(axis=1)
            best[rows] = now.argmax(axis=1)
            change = now < (top - penalty)[:, None]
            switched[rows] = change
            np.copyto(now, (top - penalty)[:, None], where=change)
        now += scores[rows]
    labels = np.zeros(len(scores), dtype=np.int16)
    state = value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        rows = starts[:k] + t
        own = state[:k]
        labels[rows] = own
        if t:
            state[:k] = np.where(switched[rows, own], best[rows], own)
    return labels


def _predict(texts: list[str | None], scorer: _Scorer, part_chars: int = 500_000) -> Iterator[tuple[str, float, list[dict]]]:
    model = scorer.model
    # Words are kept as scores and lengths; their strings live for a small part of the texts at a time.
    found = []
    for part in blocks(texts, part_chars):
        split = [_WORD.findall(t.lower()) if t and model.languages else [] for t in texts[part]]
        words = [w for ws in split for w in ws]
        rows, sizes = scorer.rows(words), np.array([len(ws) for ws in split])
        keep = rows >= 0
        ordinal = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        letters = np.fromiter(map(len, words), dtype=np.int32, count=len(words))
        doc = np.repeat(np.arange(part.start, part.stop), sizes)
        found.append((scorer.table[rows[keep]], doc[keep].astype(np.int32), ordinal[keep].astype(np.int32), letters[keep]))
        del split, words
    if not found:
        return
    scores, doc, ordinal, letters = (np.concatenate(x) for x in zip(*found, strict=True))
    del found
    lengths = np.bincount(doc, minlength=len(texts))
    labels = viterbi(scores, lengths, model.penalty)
    n = len(model.languages)
    mass = np.bincount(doc.astype(np.int64) * max(1, n) + labels, weights=letters, minlength=len(texts) * max(1, n)).reshape(len(texts), max(1, n))
    ends = np.cumsum(lengths)
    for i in range(len(texts)):
        if not lengths[i]:
            yield UNDETERMINED, 0.0, []
            continue
        at = slice(ends[i] - lengths[i], ends[i])
        own, place = labels[at], ordinal[at]
        cut = np.flatnonzero(np.diff(own)) + 1
        first, last = np.append(0, cut), np.append(cut, len(own)) - 1
        spans = [{"lang": model.languages[own[a]], "first_word": int(place[a]), "last_word": int(place[b])} for a, b in zip(first, last, strict=True)]
        top = int(mass[i].argmax())
        yield model.languages[top], float(mass[i, top] / mass[i].sum()), spans


SPANS = T.ArrayType(
    T.StructType([T.StructField("lang", T.StringType()), T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType())])
)


def identify(docs: DataFrame, model: Model, block_chars: int = 8_000_000) -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` and ``lang_spans`` (in words of letters, from 0).

    All columns stay; own ones of these three names are replaced.
    """
    new = {"lang_pred": T.StringType(), "lang_score": T.DoubleType(), "lang_spans": SPANS}
    docs = docs.drop(*new)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            for part in blocks(texts, block_chars):
                made = list(_predict(texts[part], scorer))
                out = batch.iloc[part].copy()
                for i, name in enumerate(new):
                    out[name] = [m[i] for m in made]
                yield out

    return map_rows(docs, run, [T.StructField(k, v) for k, v in new.items()])
