"""Token counts by a tokenizer compiled to finite-state transducers.

The tokenizer is byte-pair encoding with word ends over the words of one fixed pattern. It is compiled to
two deterministic transducers in cascade:

* ``Splitter`` reads character classes and emits where words begin, one character late for contractions. It has
  six states, so the map of a chunk of text from start to end state is six numbers. All chunks
  are run from all states side by side, the maps are composed by a parallel prefix scan, and
  the chunks, whose true start states are then known, are run once more to emit.
* ``Merger`` reads the bytes of a word and a word end. Each transition carries the change in the number of
  tokens; the sum over a word is its number of tokens. Its states are built when first entered
  and kept in a table: after a prefix of a word, the last token of its encoding is the one token
  that ends there and may follow the last token before it, so a state is, for every suffix of the prefix
  that a longer token could begin with, what may still come of it after the token before. All words of a block advance side by side.

Two tokens may follow each other if no pair across their border would have been merged before the parts of that
pair went into others. This is exact for encodings that merge pairs in order of rank, and the tests
compare it with the library. States that can still lead to the same tokens only are one state.

Texts are read whole and never shuffled. The tables are read from the file on the driver and broadcast: their size
is that of the vocabulary. A worker keeps at most ``STATES`` states and begins anew beyond them, so memory is bounded.

Nulls: a null text is an empty one, with no tokens. Null and repeated ids are kept, ids keep their type. The strings
of special tokens in a text count as one token each, as the library does by default. Other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from answerframe.llm.common import blocks

# Fixed value: the pattern of words whose transducer this is.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END_OF_WORD = "</w>"
CHUNK = 256
STATES = 1 << 16
FEW = 24
_END = 256

# Character classes and states of the splitter.
SPACE, NUMBER, OTHER, APOSTROPHE, LETTER, LONE, LEADS, E, L = range(9)
BREAK, WORD, MARKS, QUOTE, QUOTE_E, QUOTE_L = range(6)
HERE, BEFORE = 1, 2


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission (a word begins here, or began one character before) by state and class."""
    to, emit = np.zeros((6, 9), dtype=np.uint8), np.zeros((6, 9), dtype=np.uint8)
    letters = (LETTER, LONE, LEADS, E, L)
    for state in range(6):
        begins = {SPACE: (BREAK, 0), NUMBER: (BREAK, HERE), OTHER: (MARKS, HERE), APOSTROPHE: (QUOTE, HERE), **{c: (WORD, HERE) for c in letters}}
        if state == WORD:
            begins.update({c: (WORD, 0) for c in letters})
        elif state in (MARKS, QUOTE):
            begins.update({OTHER: (MARKS, 0), APOSTROPHE: (MARKS, 0)})
        if state == QUOTE:
            begins.update({LONE: (BREAK, 0), LEADS: (QUOTE_E, 0), L: (QUOTE_L, 0)})
        if state in (QUOTE_E, QUOTE_L):
            # The letter after the quote began a word unless the contraction is completed now.
            begins = {c: (s, e | BEFORE) for c, (s, e) in begins.items()}
            begins.update({c: (WORD, BEFORE) for c in letters})
            begins[E if state == QUOTE_E else L] = (BREAK, 0)
        for c, (s, e) in begins.items():
            to[state, c], emit[state, c] = s, e
    return to, emit


NEXT, EMIT = _splitter()


def scan(maps: np.ndarray) -> np.ndarray:
    """Parallel prefix scan: row ``k`` becomes the composition of the state maps 0 to ``k``."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), axis=1)
        step *= 2
    return maps


def word_starts(classes: np.ndarray) -> np.ndarray:
    """Where words begin in a text of classes that starts at a break and ends with a space."""
    n = -(-len(classes) // CHUNK)
    lanes = np.full(n * CHUNK, SPACE, dtype=np.uint8)
    lanes[: len(classes)] = classes
    lanes = np.ascontiguousarray(lanes.reshape(n, CHUNK).T)
    flat_next, flat_emit = NEXT.ravel(), EMIT.ravel()
    maps = np.repeat(np.arange(6, dtype=np.uint8)[None, :], n, axis=0)
    for row in lanes:
        maps = flat_next[maps * np.uint8(9) + row[:, None]]
    state = np.zeros(n, dtype=np.uint8)
    state[1:] = scan(maps)[:-1, BREAK]
    emitted = np.zeros((CHUNK, n), dtype=np.uint8)
    for k, row in enumerate(lanes):
        at = state * np.uint8(9) + row
        emitted[k], state = flat_emit[at], flat_next[at]
    emitted = emitted.T.ravel()[: len(classes)]
    begins = (emitted & HERE).astype(bool)
    begins[:-1] |= (emitted[1:] & BEFORE).astype(bool)
    return begins


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else one from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


@dataclass
class Merger:
    """The transducer over bytes and word ends; nodes are those of the prefix tree of all tokens."""

    ranks: dict[tuple[int, int], int]
    parts: dict[int, tuple[int, int, int]]  # merged token: its two parts and the rank of their merge
    child: dict[int, int]  # node * 257 + symbol: node
    token_at: list[int]
    inner: bytearray  # nodes with children
    children: dict[int, list[int]]
    spines: dict[tuple[int, int], list] = field(default_factory=dict)
    below: dict[int, tuple[int, ...] | None] = field(default_factory=dict)
    needs: dict[tuple, int | tuple[int, ...]] = field(default_factory=dict)
    states: list[tuple] = field(default_factory=list)
    numbers: dict[tuple, int] = field(default_factory=dict)
    to: np.ndarray | None = None
    change: np.ndarray | None = None

    @classmethod
    def build(cls, vocab: dict[str, int], merges: list) -> Merger:
        letter = {c: b for b, c in enumerate(_byte_letters())}

        def symbols(token: str) -> tuple[int, ...]:
            return (*(letter[c] for c in token[: -len(END_OF_WORD)]), _END) if token.endswith(END_OF_WORD) else tuple(letter[c] for c in token)

        names = list(vocab)
        number = {name: i for i, name in enumerate(names)}
        tokens = [symbols(name) for name in names]
        ranks, parts = {}, {}
        for rank, pair in enumerate(merges):
            a, b = (number[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            if (a, b) in ranks:
                raise ValueError("a pair is merged at two ranks")
            ranks[a, b] = rank
            # The one way in which a token comes about: what is merged first.
            parts.setdefault(number[names[a] + names[b]], (a, b, rank))
        child: dict[int, int] = {}
        token_at, inner = [-1], bytearray(1)
        for i, token in enumerate(tokens):
            node = 0
            for s in token:
                inner[node] = 1
                node = child.setdefault(node * 257 + s, len(token_at))
                if node == len(token_at):
                    token_at.append(-1)
                    inner.append(0)
            token_at[node] = i
        children: dict[int, list[int]] = {}
        for edge, node in child.items():
            children.setdefault(edge // 257, []).append(node)
        return cls(ranks, parts, child, token_at, inner, children)

    def _spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """A token, its last (or first) part, that part's, and so on: each with the ranks that form and that end it."""
        known = self.spines.get((token, side))
        if known is None:
            known, above, part = [], 1 << 60, token
            while True:
                first, last, rank = self.parts.get(part, (0, 0, -1))
                known.append((part, rank, above))
                if rank < 0:
                    break
                above, part = rank, last if side else first
            self.spines[token, side] = known
        return known

    def may_follow(self, before: int, token: int) -> bool:
        """Whether ``token`` may stand after ``before`` (-1: at the start of a word).

        It may not if some pair across the border would have been merged while both of its parts stood
        there. At equal ranks the merge on the left comes first.
        """
        if before < 0:
            return True
        for a, formed_a, ended_a in self._spine(before, 1):
            for b, formed_b, ended_b in self._spine(token, 0):
                merge = self.ranks.get((a, b))
                if merge is not None and formed_a < merge < ended_a and formed_b < merge <= ended_b:
                    return False
        return True

    def _below(self, node: int) -> list[int] | None:
        """The tokens below a node; None if there are more than ``FEW``."""
        if node not in self.below:
            found, open_nodes = [], list(self.children.get(node, ()))
            while open_nodes and len(found) <= FEW:
                x = open_nodes.pop()
                if self.token_at[x] >= 0:
                    found.append(self.token_at[x])
                open_nodes.extend(self.children.get(x, ()))
            self.below[node] = tuple(sorted(found)) if len(found) <= FEW else None
        return self.below[node]

    def _needed(self, node: int, before: int | tuple[int, ...]) -> int | tuple[int, ...] | None:
        """What a state has to know of the token before a suffix: which tokens may still come of it; None if none may.

        Below a node of many tokens this is the token before; otherwise the tokens themselves, so that states
        which differ in nothing that can still happen are one.
        """
        known = self.needs.get((node, before))
        if known is None:
            few = self._below(node)
            if few is None:
                known = before
            elif isinstance(before, tuple):
                known = tuple(t for t in before if t in few)
            else:
                known = tuple(t for t in few if self.may_follow(before, t))
            self.needs[node, before] = known
        return known

    def reset(self) -> None:
        self.states, self.numbers, self.needs = [], {}, {}
        self.to = np.full((1024, 257), -1, dtype=np.int32)
        self.change = np.zeros((1024, 257), dtype=np.int8)
        self.number(((0, -1, 0),))

    def number(self, state: tuple) -> int:
        """A state is, by suffix, its node, the last token before it, and the tokens since then."""
        known = self.numbers.get(state)
        if known is None:
            known = self.numbers[state] = len(self.states)
            self.states.append(state)
            if known >= len(self.to):
                more = len(self.to)
                self.to = np.concatenate([self.to, np.full((more, 257), -1, dtype=np.int32)])
                self.change = np.concatenate([self.change, np.zeros((more, 257), dtype=np.int8)])
        return known

    def extend(self, state: int, symbol: int) -> None:
        """Build the transition of a state with a symbol."""
        going, last = [], None
        for node, before, since in self.states[state]:
            to = self.child.get(node * 257 + symbol)
            if to is None:
                continue
            token = self.token_at[to]
            if token >= 0 and last is None and (token in before if isinstance(before, tuple) else self.may_follow(before, token)):
                last = (token, 1 - since)
            if self.inner[to] and (needed := self._needed(to, before)) != ():
                going.append((to, needed, since))
        if last is None:
            raise ValueError("no token ends here: the vocabulary lacks a byte")
        token, change = last
        number = 0 if symbol == _END else self.number((*((n, b, s + change) for n, b, s in going), (0, token, 0)))
        self.to[state, symbol], self.change[state, symbol] = number, change

    def counts(self, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each word, given as places and lengths in an array of bytes."""
        if self.to is None or len(self.states) > STATES:
            self.reset()
        order = np.argsort(-size, kind="stable")
        at, longest = start[order], size[order]
        state = np.zeros(len(order), dtype=np.int64)
        total = np.zeros(len(order), dtype=np.int64)
        active = np.searchsorted(-longest, -np.arange(1, int(longest[0]) + 1 if len(longest) else 1), side="right")
        for k, n in enumerate(active.tolist()):
            if len(self.states) > STATES:
                state = self._begin_anew(state, n)
            self._advance(state, total, n, text[at[:n] + k].astype(np.int64))
        self._advance(state, total, len(order), np.full(len(order), _END))
        counted = np.empty(len(order), dtype=np.int64)
        counted[order] = total
        return counted

    def _begin_anew(self, state: np.ndarray, n: int) -> np.ndarray:
        """Forget all states but those that words are in."""
        live, place = np.unique(state, return_inverse=True)
        held = [self.states[s] for s in live.tolist()]
        self.reset()
        return np.array([self.number(s) for s in held], dtype=np.int64)[place]

    def _advance(self, state: np.ndarray, total: np.ndarray, n: int, symbol: np.ndarray) -> None:
        at = state[:n] * 257 + symbol
        to = self.to.ravel()[at]
        new = to < 0
        if new.any():
            for s, b in {divmod(x, 257) for x in at[new].tolist()}:
                self.extend(s, b)
            to = self.to.ravel()[at]
        total[:n] += self.change.ravel()[at]
        state[:n] = to


@dataclass
class Counter:
    """A compiled tokenizer."""

    special: tuple[str, ...]
    classes: np.ndarray
    merger: Merger
    # Letters whose lower case differs between the Unicode versions of Python and of the library.
    lower: dict[str, str] = field(default_factory=dict)

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        counts = np.zeros(len(texts), dtype=np.int64)
        pieces, owner = [], []
        for k, text in enumerate(texts):
            parts = [text] if text else []
            for name in self.special:
                if any(name in part for part in parts):
                    split = [part.split(name) for part in parts]
                    counts[k] += sum(len(s) - 1 for s in split)
                    parts = [p for s in split for p in s if p]
            for part in parts:
                pieces.append(normal(part, self.lower))
                owner.append(k)
        if not pieces:
            return counts
        joined = " ".join(pieces) + " "
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        classes = self.classes[points]
        begins = word_starts(classes)
        first = np.flatnonzero(begins)
        # A word ends where the next begins or at the next space, whichever is first.
        breaks = np.flatnonzero(begins | (classes == SPACE))
        last = breaks[np.searchsorted(breaks, first, side="right")]
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        place = np.concatenate([[0], np.cumsum(width)])
        text = np.frombuffer(joined.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        tokens = self.merger.counts(text, place[first], place[last] - place[first])
        ends = np.cumsum([len(p) + 1 for p in pieces])
        per_piece = np.bincount(np.searchsorted(ends, first, side="right"), weights=tokens, minlength=len(pieces))
        np.add.at(counts, owner, per_piece.astype(np.int64))
        return counts


def normal(text: str, lower: dict[str, str] | None = None) -> str:
    """Composed form in lower case, letter by letter (so without the rule for a last sigma)."""
    if text.isascii():
        return text.lower()
    composed = unicodedata.normalize("NFC", text)
    if lower and not lower.keys().isdisjoint(composed):
        return "".join(lower[c] if c in lower else "σ" if c == "Σ" else c.lower() for c in composed)
    return composed.replace("Σ", "σ").lower()


def compile_tokenizer(path: str) -> Counter:
    """The transducers of a tokenizer file; refuses files of another kind."""
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    splits = [s for s in spec["pre_tokenizer"].get("pretokenizers", []) if s["type"] == "Split"]
    normal_steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    plain = not (model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"))
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != END_OF_WORD or not plain or normal_steps != ["NFC", "Replace", "Lowercase"]:
        raise ValueError("only byte-pair encoding with word ends in lower case can be compiled")
    if len(splits) != 1 or splits[0]["pattern"] != {"Regex": PATTERN} or splits[0]["behavior"] != "Removed" or not splits[0]["invert"]:
        raise ValueError("the words of this tokenizer have another pattern")
    if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("added tokens must be plain strings")
    # Classes of all characters, as the library's own patterns see them.
    # Nothing is assigned from 40000 to DFFFF, and what comes after is neither space, number nor letter.
    points = [p for p in range(0x40000) if not 0xD800 <= p < 0xE000]
    everything = "".join(map(chr, points))
    classes = np.full(0x110000, OTHER, dtype=np.uint8)
    number = np.array(points)
    for pattern, kind in ((r"\s", SPACE), (r"\p{N}", NUMBER), (r"\p{L}", LETTER)):
        found = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(everything)
        classes[number[[a for _, (a, _) in found]]] = kind
    for letters, kind in (("'", APOSTROPHE), ("stmd", LONE), ("rv", LEADS), ("e", E), ("l", L)):
        classes[[ord(c) for c in letters]] = kind
    spaces = set(np.flatnonzero(classes == SPACE).tolist())
    cased = [chr(p) for p in points if p > 127 and p not in spaces]
    theirs = Tokenizer.from_file(path).normalizer.normalize_str("|".join(cased)).split("|")
    lower = {c: t for c, t in zip(cased, theirs, strict=True) if t != normal(c)}
    special = tuple(sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True))
    return Counter(special, classes, Merger.build(model["vocab"], model["merges"]), lower)


def token_counts(docs: DataFrame, path: str, block_chars: int = 1_000_000) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row of ``doc_id, text``."""
    shared = docs.sparkSession.sparkContext.broadcast(compile_tokenizer(path))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            tokens = np.zeros(len(texts), dtype=np.int64)
            for part in blocks(texts, block_chars):
                tokens[part] = counter.count(texts[part])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens)], schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, schema)
