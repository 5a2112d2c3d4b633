"""Secrets in texts: fixed patterns, and a character network for what they miss or cut short.

Every candidate, that is every run of at least 12 secret-like characters, is scored together
with its surroundings by a small convolutional network written in numpy: characters are
embedded, convolved, and the strongest response of each filter inside and outside the candidate
goes to a logistic unit. It is trained on labelled findings: runs that hold a finding of a pattern
are secrets; runs of plain words and short numbers, with no finding and no telling word before
them, are not; all others have no label and are only scored. Findings of patterns look alike, so
each is learned once more in other alphabets and without a telling word, beside a plain run made of
words, numbers and dates (``written_anew``). A third of the examples, chosen by a hash, with such copies of its own, calibrates the scores
(Platt) and sets the threshold: the highest at which the wanted share of its secrets is found. Runs at or above it are added whole as kind ``net``, unless
a pattern found exactly the same; what the patterns find always stays.

Training takes every distinct labelled piece of all texts. They are shuffled twice: to become distinct, and by
a hash into parts of bounded size, each a row of a written table. In each round every part goes on from the
common network over all its examples, and the mean of what the parts learned is the next one; only its 2,253
numbers pass through the driver, as do the counts of held-out scores rounded to 1/256. The scan is a map over
whole texts without a shuffle.

Nulls and ties: a null text has no secrets. Without examples of both classes nothing is added.
Longer candidates than the network's width are scored in pieces, and the highest counts.
Spans are code points, end exclusive, ordered by start, then kind as listed. Spans of different
kinds may overlap; ``redact`` merges them. Repeated rows are treated alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import accumulate, takewhile
from string import ascii_letters, ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerframe.llm.common import blocks, lean, map_rows
from answerframe.session import written

KINDS = ("assign", "access", "hex", "net")
# The patterns and the least length of each.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_HINTS = ("passw", "secret", "token", "api")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
_HINT = re.compile(r"pass|pwd|secret|token|key|auth|cred|bearer|login", re.IGNORECASE | re.ASCII)
# Words as they are written, and numbers as short as those of dates, joined by marks.
_PLAIN = re.compile(r"(?:[A-Z]?[a-z]*+|[A-Z]++|[0-9]{1,8}+)(?:[+/_.=-]++(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,8}+|(?=[+/_.=-]|\Z)))*+")

AROUND, WIDTH = 24, 48
_LENGTH = AROUND + WIDTH + AROUND
_CLASSES = 98  # 0: nothing, 1: other, 2: line break, 3 on: printable ASCII
# Classes of the characters that secrets are written in elsewhere, letters before digits, and of marks between pieces.
_ALPHABETS = [
    np.frombuffer((letters + "0123456789").encode(), dtype=np.uint8) - 29
    for letters in (ascii_lowercase, ascii_uppercase, ascii_letters, ascii_letters + "_-", ascii_letters + "+/")
] + [np.frombuffer(ascii_letters.encode(), dtype=np.uint8) - 29]
_MARKS = np.frombuffer(b"-_/.=", dtype=np.uint8) - 29

# Learning: examples of a part, the least of a class in each part, steps of a part in a round at least, step widths of the rounds.
PART, LEAST, STEPS, RATES = 32_768, 512, 200, (0.01, 0.01, 0.005, 0.002)
_LEARNED = ("embedding", "filters", "filter_bias", "unit", "unit_bias")
_BATCH, _TEXT, _FINE, _UNIT = 128, 4_000_000, 256, 1 << 32


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of what the patterns find."""
    out = []
    low = text.lower()
    # ``lower`` may move places but never hides an ASCII word, so it only decides whether to look.
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    """All runs of secret-like characters, whether a pattern's span touches them or not."""
    return [m.span() for m in _RUN.finditer(text)]


def labelled(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
    """``start, end, label`` of the candidates whose label is known."""
    out, k = [], 0
    spans = sorted((s, e) for s, e, _ in base)
    reach = list(accumulate((e for _, e in spans), max))
    for a, b in candidates(text):
        while k < len(spans) and reach[k] <= a:
            k += 1
        if k < len(spans) and any(s < b and a < e for s, e in takewhile(lambda x: x[0] < b, spans[k:])):
            out.append((a, b, 1))
        elif _PLAIN.fullmatch(text, a, b) and not _HINT.search(text, max(0, a - AROUND), b):
            out.append((a, b, 0))
    return out


def windows(text: str, start: int, end: int) -> list[tuple[str, str, str]]:
    """The candidate in pieces of the network's width, each with what surrounds it."""
    return [(text[max(0, a - AROUND) : a], text[a : min(end, a + WIDTH)], text[min(end, a + WIDTH) : min(end, a + WIDTH) + AROUND]) for a in range(start, end, WIDTH)]


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return np.where((codes > 31) & (codes < 127), codes - 29, np.where(codes == 10, 2, 1)).astype(np.uint8)


def encode(parts: list[tuple[str, str, str]]) -> np.ndarray:
    """Character classes, the text before right-aligned to the candidate's first place."""
    out = np.zeros((len(parts), _LENGTH), dtype=np.uint8)
    for i, (before, inner, after) in enumerate(parts):
        for at, piece in ((AROUND - len(before), before), (AROUND, inner), (AROUND + WIDTH, after)):
            out[i, at : at + len(piece)] = classes(piece)
    return out


def encode_at(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same for pieces of a whole text, whose classes have ``AROUND`` zeros before and ``_LENGTH`` after them."""
    inner = starts[:, None] + np.arange(WIDTH)
    return np.concatenate(
        [
            padded[starts[:, None] + np.arange(AROUND)],
            np.where(inner < ends[:, None], padded[inner + AROUND], 0).astype(np.uint8),
            padded[ends[:, None] + AROUND + np.arange(AROUND)],
        ],
        axis=1,
    )


@dataclass
class Network:
    """Embedding, convolution over ``reach`` characters, two poolings, a logistic unit, calibration."""

    embedding: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    unit: np.ndarray
    unit_bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0
    reach: int = 5

    def forward(self, codes: np.ndarray) -> tuple:
        e = self.embedding[codes]
        n = _LENGTH - self.reach + 1
        columns = np.concatenate([e[:, k : k + n] for k in range(self.reach)], axis=2)
        responses = np.maximum(columns @ self.filters + self.filter_bias, 0)
        inside = slice(AROUND - 2, AROUND + WIDTH - 2)
        outside = np.concatenate([responses[:, : AROUND - 2], responses[:, AROUND + WIDTH - 2 :]], axis=1)
        pooled = np.concatenate([responses[:, inside].max(axis=1), outside.max(axis=1)], axis=1)
        return columns, responses, pooled, pooled @ self.unit + self.unit_bias

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """The unit's sums; a character's share in a filter at each of its places is looked up, not multiplied anew."""
        width, n = self.embedding.shape[1], _LENGTH - self.reach + 1
        shares = [self.embedding @ self.filters[k * width : (k + 1) * width] for k in range(self.reach)]
        out = np.zeros(len(codes))
        for i in range(0, len(codes), 256):
            block = codes[i : i + 256]
            responses = np.take(shares[0], block[:, :n], axis=0)
            for k in range(1, self.reach):
                responses += np.take(shares[k], block[:, k : k + n], axis=0)
            inside = responses[:, AROUND - 2 : AROUND + WIDTH - 2].max(axis=1)
            outside = np.maximum(responses[:, : AROUND - 2].max(axis=1), responses[:, AROUND + WIDTH - 2 :].max(axis=1))
            pooled = np.maximum(np.concatenate([inside + self.filter_bias, outside + self.filter_bias], axis=1), 0)
            out[i : i + 256] = pooled @ self.unit + self.unit_bias
        return out

    def probability(self, codes: np.ndarray) -> np.ndarray:
        z = self.scores(codes)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -35, 35)))


def untrained(width: int = 10, n_filters: int = 24, seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    return Network(
        rng.normal(0, 0.3, (_CLASSES, width)).astype(np.float32), rng.normal(0, 0.2, (5 * width, n_filters)).astype(np.float32),
        np.zeros(n_filters, np.float32), rng.normal(0, 0.2, 2 * n_filters).astype(np.float32), 0.0,
    )


def gradients(net: Network, codes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted logistic loss. Only the place of each filter's strongest response takes part."""
    width, n_filters, n = net.embedding.shape[1], len(net.filter_bias), _LENGTH - net.reach + 1
    parts = net.filters.reshape(net.reach, width, n_filters)
    shares = net.embedding @ parts
    codes = codes.astype(np.intp)
    responses = np.take(shares[0], codes[:, :n], axis=0)
    for k in range(1, net.reach):
        responses += np.take(shares[k], codes[:, k : k + n], axis=0)
    responses = np.ascontiguousarray(responses.transpose(0, 2, 1))
    ends = np.concatenate([responses[:, :, : AROUND - 2], responses[:, :, AROUND + WIDTH - 2 :]], axis=2)
    top_in = responses[:, :, AROUND - 2 : AROUND + WIDTH - 2].argmax(axis=2) + AROUND - 2
    top_out = ends.argmax(axis=2)
    top_out += WIDTH * (top_out >= AROUND - 2)
    top = np.concatenate([top_in, top_out], axis=1)
    both = np.tile(np.arange(n_filters), 2)
    rows = np.arange(len(codes))[:, None]
    pooled = np.maximum(responses[rows, both, top] + np.tile(net.filter_bias, 2), 0)
    z = pooled @ net.unit + net.unit_bias
    d = ((1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels) * weight / len(codes)).astype(np.float32)
    d_top = d[:, None] * net.unit * (pooled > 0)
    size = _CLASSES * n_filters
    d_shares = np.stack([np.bincount((codes[rows, top + k] * n_filters + both).ravel(), d_top.ravel(), size) for k in range(net.reach)])
    d_shares = d_shares.reshape(net.reach, _CLASSES, n_filters).astype(np.float32)
    return {
        "embedding": (d_shares @ parts.transpose(0, 2, 1)).sum(axis=0), "filters": (net.embedding.T @ d_shares).reshape(net.filters.shape),
        "filter_bias": d_top.sum(axis=0).reshape(2, n_filters).sum(axis=0), "unit": pooled.T @ d, "unit_bias": d.sum(),
    }


def learn(net: Network, codes: np.ndarray, labels: np.ndarray, steps: int, rate: float, seed: int) -> Network:
    """Adam on the logistic loss from ``net`` on, both classes of equal weight.

    Each pass takes all examples, those of a rare class several times, and there are as many passes as ``steps`` take.
    """
    rng = np.random.default_rng(seed)
    net = replace(net)
    moments = {k: [np.zeros_like(np.asarray(getattr(net, k), dtype=np.float32)) for _ in range(2)] for k in _LEARNED}
    sides = [np.flatnonzero(labels == y) for y in (0, 1)]
    most = max(map(len, sides))
    taken = np.concatenate([np.tile(side, max(1, most // max(1, 3 * len(side)))) for side in sides])
    shown = np.bincount(labels[taken], minlength=2)
    weight = (0.5 * len(taken) / np.maximum(shown, 1))[labels]
    step = 0
    for _ in range(max(1, -(-steps * _BATCH // max(1, len(taken))))):
        order = rng.permutation(taken)
        for batch in (order[i : i + _BATCH] for i in range(0, len(order), _BATCH)):
            step += 1
            for k, g in gradients(net, codes[batch], labels[batch], weight[batch]).items():
                first, second = moments[k]
                moments[k] = [0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g]
                first, second = (m / (1 - decay**step) for m, decay in zip(moments[k], (0.9, 0.999), strict=True))
                setattr(net, k, getattr(net, k) - rate * first / (np.sqrt(second) + 1e-8))
    return net


def fit(codes: np.ndarray, labels: np.ndarray, epochs: int = 12, width: int = 10, n_filters: int = 24, seed: int = 5) -> Network:
    """A network from these examples alone."""
    return learn(untrained(width, n_filters, seed), codes, labels, epochs * len(labels) // _BATCH, 0.01, seed)


def calibrate(net: Network, codes: np.ndarray, labels: np.ndarray, recall: float) -> Network:
    """Platt scaling on held-out examples, then the highest threshold with at least ``recall``."""
    return calibrate_counted(net, net.scores(codes), labels, np.ones(len(labels)), recall)


def calibrate_counted(net: Network, z: np.ndarray, labels: np.ndarray, counts: np.ndarray, recall: float) -> Network:
    """The same from the sums of held-out examples, each with how many have it."""
    secrets, plain = counts[labels == 1].sum(), counts[labels == 0].sum()
    target = np.where(labels == 1, (secrets + 1) / (secrets + 2), 1 / (plain + 2))
    mean = lambda x: (x * counts).sum() / counts.sum()
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
        g = np.array([mean((p - target) * z), mean(p - target)])
        w = p * (1 - p) + 1e-6
        h = np.array([[mean(w * z * z) + 1e-6, mean(w * z)], [mean(w * z), mean(w)]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -1, 1)
    net.slope, net.shift = float(a), float(b)
    p = (1 / (1 + np.exp(-np.clip(a * z + b, -35, 35))))[labels == 1]
    order = np.argsort(p, kind="stable")
    passed = np.cumsum(counts[labels == 1][order])
    net.threshold = float(p[order][np.searchsorted(passed, int((1 - recall) * secrets), side="right")])
    return net


def examples(docs: DataFrame) -> DataFrame:
    """``codes, label`` of the distinct labelled pieces of all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in blocks(batch["text"].tolist(), _TEXT):
                rows: set[tuple[bytes, int]] = set()
                for text in batch["text"].iloc[part]:
                    runs = labelled(text, base_spans(text))
                    if runs:
                        for owners, codes in _pieces(text, [(a, b) for a, b, _ in runs]):
                            rows.update((row.tobytes(), runs[k][2]) for row, k in zip(codes, owners.tolist(), strict=True))
                yield pd.DataFrame(list(rows), columns=["codes", "label"])

    return docs.filter("text is not null").select("text").mapInPandas(lean(run), "codes binary, label int").distinct()


def dealt(found: DataFrame, part_size: int = PART) -> tuple[DataFrame, dict[tuple[bool, int], int], int] | None:
    """All examples in parts of about ``part_size``, a row each: ``held, part, codes, labels, own``; their counts; the parts to learn from.

    A third is held out. Examples of a class with too few for all parts are copied to several, but are ``own`` to one.
    None, if either side lacks secrets or other candidates.
    """
    found = found.withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "codes"), F.lit(3)) == 2)
    counts = {(r["held"], r["label"]): r["count"] for r in found.groupBy("held", "label").count().collect()}
    if any(counts.get((held, y), 0) < 5 for held in (False, True) for y in (0, 1)):
        return None
    parts = {held: -(-(counts[held, 0] + counts[held, 1]) // part_size) for held in (False, True)}
    n_parts = F.when(F.col("held"), F.lit(parts[True])).otherwise(F.lit(parts[False]))
    copies = F.coalesce(*[
        F.when((F.col("held") == held) & (F.col("label") == y), F.lit(min(parts[held], -(-LEAST * parts[held] // n)))) for (held, y), n in counts.items()
    ])
    copied = found.select("*", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    placed = copied.withColumn("part", F.pmod(F.pmod(F.xxhash64(F.lit("part"), "codes"), n_parts) + F.col("copy"), n_parts))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["codes", "label"])
        flags = [rows["label"].to_numpy(dtype=np.uint8).tobytes(), (rows["copy"] == 0).to_numpy(dtype=np.uint8).tobytes()]
        return pd.DataFrame([(*key, b"".join(rows["codes"]), *flags)], columns=["held", "part", "codes", "labels", "own"])

    schema = "held boolean, part long, codes binary, labels binary, own binary"
    packed = placed.groupBy("held", "part").applyInPandas(pack, schema)
    # A part to a file, so that a reader never holds many at once.
    return written(packed, "secret-parts", maxRecordsPerFile=1), counts, parts[False]


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part, codes, labels, own in zip(batch["part"], batch["codes"], batch["labels"], batch["own"], strict=True):
            yield (
                int(part), np.frombuffer(codes, np.uint8).reshape(-1, _LENGTH), np.frombuffer(labels, np.uint8).astype(np.int64),
                np.frombuffer(own, np.uint8) == 1,
            )


def train(docs: DataFrame, recall: float = 0.95, part_size: int = PART) -> Network | None:
    """Learn from ``text``; None if there are too few secrets or other candidates."""
    deal = dealt(written(examples(docs), "secret-examples"), part_size)
    if deal is None:
        return None
    packed, _, n_parts = deal
    net = untrained()
    for i, rate in enumerate(RATES):
        net = _averaged(packed.filter("not held"), net, n_parts, i, rate)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, codes, labels, own in _unpacked(batches):
            codes, labels = written_anew(codes, labels, 8 + part, own)
            # Rounded down, so the threshold is never above what the wanted share reaches.
            z = np.floor(np.clip(net.scores(codes), -128, 128) * _FINE).astype(np.int64)
            yield pd.DataFrame({"z": z, "label": labels}).value_counts().reset_index(name="n")

    seen = packed.filter("held").mapInPandas(lean(sums), "z long, label long, n long").groupBy("z", "label").agg(F.sum("n").alias("n"))
    got = seen.orderBy("z", "label").toPandas()
    return calibrate_counted(net, got["z"].to_numpy() / _FINE, got["label"].to_numpy(), got["n"].to_numpy(dtype=np.float64), recall)


def _averaged(packed: DataFrame, net: Network, n_parts: int, turn: int, rate: float) -> Network:
    """The mean of the networks that the parts learn from ``net`` on, added up in whole numbers: their order changes nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, codes, labels, _ in _unpacked(batches):
            codes, labels = written_anew(codes, labels, 7 + part * len(RATES) + turn)
            own = learn(net, codes, labels, STEPS, rate, part * len(RATES) + turn)
            values = np.concatenate([np.ravel(getattr(own, k)) for k in _LEARNED]).astype(np.float64)
            yield pd.DataFrame({"place": np.arange(len(values)), "value": np.round(values * _UNIT).astype(np.int64)})

    total = packed.mapInPandas(lean(run), "place int, value long").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place")
    values = total.toPandas()["value"].to_numpy(dtype=np.float64) / (_UNIT * n_parts)
    out, at = replace(net), 0
    for k in _LEARNED:
        shape = np.shape(getattr(net, k))
        n = int(np.prod(shape))
        setattr(out, k, values[at : at + n].reshape(shape).astype(np.float32) if shape else float(values[at]))
        at += n
    return out


def written_anew(codes: np.ndarray, labels: np.ndarray, seed: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The examples (with ``own``: only those), and for each secret of them two more between the surroundings of plain runs.

    One is a secret as long as it, in characters drawn from another alphabet and now and then behind a
    short prefix; the other is plain: pieces of plain runs, numbers and dates, joined by marks.
    """
    rng = np.random.default_rng(seed)
    plain = codes[labels == 0]
    plain_inner = plain[:, AROUND : AROUND + WIDTH]
    if own is not None:
        codes, labels = codes[own], labels[own]
    secrets = codes[labels == 1]
    if not len(plain) or not len(secrets):
        return codes, labels
    new = plain[rng.integers(0, len(plain), 2 * len(secrets))].copy()
    inner = new[:, AROUND : AROUND + WIDTH]
    inner[:] = 0
    for row, length in zip(inner[: len(secrets)], np.maximum((secrets[:, AROUND : AROUND + WIDTH] > 0).sum(axis=1), 16), strict=True):
        drawn = rng.choice(_ALPHABETS[rng.integers(len(_ALPHABETS))], length)
        if rng.random() < 0.5:
            n = rng.integers(2, 5)
            drawn[:n] = rng.choice(_ALPHABETS[0][:26], n)
            drawn[n] = rng.choice(_MARKS)
        row[:length] = drawn
    for row in inner[len(secrets) :]:
        at, mark = 0, rng.choice(_MARKS)
        while at < 12 or (at < WIDTH - 12 and rng.random() < 0.4):
            kind = rng.integers(3)
            if kind == 0:
                word = plain_inner[rng.integers(len(plain_inner))]
                piece = word[: rng.integers(3, max(4, (word > 0).sum()) + 1)][: WIDTH - at]
                piece = piece[piece > 0]
            else:
                piece = rng.choice(_ALPHABETS[0][26:], rng.choice((4, 2, 2) if kind == 1 else (1, 3, 5)))
            row[at : at + len(piece)] = piece[: WIDTH - at]
            at = min(at + len(piece), WIDTH - 1)
            row[at] = mark
            at += 1
        row[at - 1] = 0
    # Some texts are all in capitals: classes 68 to 93 are a to z, 32 less A to Z.
    small = (new >= 68) & (new <= 93) & (np.arange(len(new)) >= len(secrets))[:, None] & (rng.random(len(new)) < 0.4)[:, None]
    new[small] -= 32
    return np.concatenate([codes, new]), np.concatenate([labels, np.repeat([1, 0], len(secrets))])


def _pieces(text: str, runs: list[tuple[int, int]], block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For the runs' pieces, some at a time: which run each is of, and its classes."""
    owners = np.repeat(np.arange(len(runs)), [-(-(b - a) // WIDTH) for a, b in runs])
    starts = np.concatenate([np.arange(a, b, WIDTH) for a, b in runs])
    ends = np.minimum(starts + WIDTH, np.array([b for _, b in runs])[owners])
    padded = np.concatenate([np.zeros(AROUND, np.uint8), classes(text), np.zeros(_LENGTH, np.uint8)])
    for i in range(0, len(starts), block):
        yield owners[i : i + block], encode_at(padded, starts[i : i + block], ends[i : i + block])


def _found_by(net: Network, text: str) -> set[tuple[int, int]]:
    """Candidates of a whole text at or above the threshold."""
    runs = candidates(text)
    if not runs:
        return set()
    return {runs[k] for owners, codes in _pieces(text, runs) for k in owners[net.probability(codes) >= net.threshold].tolist()}


def _spans(texts: list[str | None], net: Network | None) -> list[list[tuple[int, int, str]]]:
    out = []
    for text in texts:
        base = base_spans(text) if text else []
        if net is not None and text:
            known = {(a, b) for a, b, _ in base}
            base = base + [(a, b, "net") for a, b in _found_by(net, text) if (a, b) not in known]
        out.append(sorted(base, key=lambda x: (x[0], KINDS.index(x[2]))))
    return out


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


def scan(docs: DataFrame, net: Network | None, mask: str | None = None) -> DataFrame:
    """``docs`` with ``secrets``, the spans found in ``text``; with ``mask``, each merged span is replaced by it.

    An own column named ``secrets`` is replaced; all others stay.
    """
    docs = docs.drop("secrets")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            found = _spans(texts, shared.value)
            batch = batch.copy()
            batch["secrets"] = [[{"kind": k, "start": a, "end": b} for a, b, k in s] for s in found]
            if mask is not None:
                batch["text"] = [redact(t, s, mask) for t, s in zip(texts, found, strict=True)]
            yield batch

    return map_rows(docs, run, [T.StructField("secrets", SPANS)])


def redact(text: str | None, spans: list[tuple[int, int, str]], mask: str) -> str | None:
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text
