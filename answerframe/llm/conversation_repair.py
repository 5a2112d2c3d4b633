"""Conversation structure repair by bidirectional Dijkstra over the edit lattice.

A conversation is put into the form ``(s?(ua)+)?`` of role initials (an optional system turn, then
user and assistant in turns, or nothing at all) by the cheapest edits of its rows in order:
Keep 0, Rerole to user or assistant 3, Delete 4 (the only choice for blank and duplicate rows),
Insert an empty user or assistant turn 3; a truncated row that stays costs 3 more.

The lattice has a node for every number of consumed rows and every state of that form. One heap
works from the start, one from the accepted ends; when they have met, all crossings of equal cost
are finished, and of all cheapest paths the one with the ASCII-least audit (the edits' initials)
is read off. An audit fixes the roles that it gives, as the form leaves a turn one role only.

Two streams over sorted rows: the first sees one code a row and returns an audit a conversation,
the second gets the audits back in front of the texts and applies them. Neither holds the texts
of a conversation; what a task holds of one is some tens of bytes for each of its rows and the
audit, which is a value of the result anyway. One shuffle of codes, one of texts.

Nulls and ties: a null role or text is one space; a null id is a conversation of its own, a null
turn comes first. Rows of one turn are ordered by role, then by the SHA-256 of the text, so that
equal rows are neighbours. Any other initial than s, u, a can stay only by Rerole. A conversation
without rows has no row here; the query adds it. Other columns than the four are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from answerframe.session import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_BLANKS = " \t\n\x0b\x0c\r"
_FAR = 1 << 60
# States: nothing yet, after s, after u, after a. What a user or assistant turn leads to from each.
_NEXT = (2, 2, 3, 2)
_FROM = ((), (), (0, 1, 3), (2,))
# Codes of a row: initial (0 s, 1 u, 2 a, 3 other) + 4 if truncated, or 8 if it must go.
GONE = 8


def _step(code: int, state: int, edit: str) -> tuple[int, int] | None:
    """State and cost after an edit of a row with this code; None if it may not be."""
    if edit == "D":
        return state, DELETE
    if code >= GONE:
        return None
    extra = TRUNCATED if code & 4 else 0
    if edit == "R":
        return _NEXT[state], REROLE + extra
    initial = code & 3
    if initial == 0:
        return (1, KEEP + extra) if state == 0 else None
    return (initial + 1, KEEP + extra) if initial < 3 and _NEXT[state] == initial + 1 else None


# By code, the edges of a row as (edit, from, to, cost).
_EDGES = {
    code: [(e, q, *to) for e in "DKR" for q in range(4) if (to := _step(code, q, e)) is not None] for code in [*range(8), GONE]
}
_OUT = {code: [[(e, to, c) for e, q, to, c in edges if q == s] for s in range(4)] for code, edges in _EDGES.items()}
_IN = {code: [[(q, c) for _, q, to, c in edges if to == s] for s in range(4)] for code, edges in _EDGES.items()}


def _outgoing(codes: bytes, node: int) -> list[tuple[str, int, int]]:
    """``edit, node, cost`` of the edges out of a node, by the edits' initials."""
    i, q = divmod(node, 4)
    row = [(e, node - q + 4 + to, c) for e, to, c in _OUT[codes[i]][q]] if i < len(codes) else []
    insert = ("I", node - q + _NEXT[q], INSERT)
    return [*row[:1], insert, *row[1:]] if row else [insert]


def _incoming(codes: bytes, node: int) -> list[tuple[int, int]]:
    i, q = divmod(node, 4)
    row = [(node - q - 4 + p, c) for p, c in _IN[codes[i - 1]][q]] if i else []
    return row + [(node - q + p, INSERT) for p in _FROM[q]]


def cheapest(codes: bytes) -> tuple[int, str]:
    """Least cost and, of all cheapest, the ASCII-least audit for rows with these codes."""
    n = len(codes)
    goals = (4 * n, 4 * n + 3)
    ahead, back = array("q", [_FAR]) * (4 * n + 4), array("q", [_FAR]) * (4 * n + 4)
    ahead_done, back_done = bytearray(4 * n + 4), bytearray(4 * n + 4)
    # Free edges lead to the next row only, so nodes of equal cost are settled in the order of rows.
    forward, reverse, settled, best = [(0, 0, 0)], [], [], _FAR
    ahead[0] = 0
    for goal in goals:
        back[goal] = 0
        heappush(reverse, (0, 0, goal))
    if n == 0:
        best = 0
    while forward and reverse and forward[0][0] + reverse[0][0] <= best:
        if forward[0][0] <= reverse[0][0]:
            cost, _, node = heappop(forward)
            if ahead_done[node]:
                continue
            ahead_done[node] = 1
            settled.append(node)
            for _, to, c in _outgoing(codes, node):
                if cost + c < ahead[to]:
                    ahead[to] = cost + c
                    heappush(forward, (cost + c, to >> 2, to))
                best = min(best, cost + c + back[to])
        else:
            cost, _, node = heappop(reverse)
            if back_done[node]:
                continue
            back_done[node] = 1
            for to, c in _incoming(codes, node):
                if cost + c < back[to]:
                    back[to] = cost + c
                    heappush(reverse, (cost + c, n - (to >> 2), to))
                best = min(best, cost + c + ahead[to])
    for goal in goals:
        back_done[goal] = 1
    # Nodes settled ahead that a cheapest path passes: they reach a crossing by tight edges.
    passed = bytearray(4 * n + 4)

    def cheap(node: int, to: int, c: int) -> bool:
        if back_done[to] and ahead[node] + c + back[to] == best:
            return True
        return bool(passed[to]) and ahead[node] + c == ahead[to]

    for node in reversed(settled):
        done = back_done[node] and ahead[node] + back[node] == best
        passed[node] = done or any(cheap(node, to, c) for _, to, c in _outgoing(codes, node))
    # The least concatenation over all crossings: at every node the least edit on a cheapest path.
    audit, node = [], 0
    while True:
        if node in goals and (ahead[node] == best if ahead_done[node] else back[node] == 0):
            # Only a goal that is reached at the least cost ends the path; no further edit is free there.
            return best, "".join(audit)
        for edit, to, c in _outgoing(codes, node):
            if cheap(node, to, c) if ahead_done[node] else back_done[to] and back[node] == c + back[to]:
                audit.append(edit)
                node = to
                break


_short = lru_cache(1 << 16)(cheapest)


def solve(codes: bytes) -> tuple[int, str]:
    """``cheapest``; answers for short conversations, of which many are alike, are kept."""
    return _short(codes) if len(codes) <= 48 else cheapest(codes)


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])


def _bare(text: Column) -> Column:
    return F.rtrim(text, F.lit(_BLANKS))


def _digest() -> Column:
    return F.sha2("text", 256).alias("digest")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch, list]]:
    """Stretches of rows with one id: whether a new conversation starts, the rows, and the id as a list of one."""
    last: list = []
    for batch in batches:
        ids = batch.column(0).to_pylist()
        start = 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or ids[i] != ids[start]:
                yield last != [ids[start]], batch.slice(start, i - start), [ids[start]]
                last = [ids[start]]
                start = i


def audits(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation with rows.

    ``rows``: ``conv_id, turn, role, text``. A row's first fault counts.
    """
    end = F.substring(_bare(F.col("text")), -1, 1)
    fault = F.when(end == "", 2).when(~end.isin(".", "!", "?"), 1).otherwise(0)
    place = F.row_number().over(W.Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first()))
    small = (
        _plain(rows)
        .select("conv_id", "turn", "role", _digest(), fault.alias("fault"))
        .repartition("conv_id")
        .withColumn("repeat", place > 1)
    )
    initial = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in (("s", 0), ("u", 1), ("a", 2)) for x in p]), F.substring("role", 1, 1)), F.lit(3))
    kind = F.when(F.col("fault") == 2, 16).when(F.col("repeat"), 32).when(F.col("fault") == 1, 4).otherwise(0)
    coded = small.select(
        "conv_id", "turn", (kind + initial).alias("code"), "role", "digest"
    ).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType([rows.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in numbers], T.StructField("audit", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kind_of: pa.DataType | None = None
        whose, codes, first, last, turns = [None], bytearray(), None, None, 0

        def close() -> None:
            initials = bytes(c & 3 for c in codes)
            bad = sum(pair not in (b"\0\1", b"\1\2", b"\2\1") for pair in (initials[i : i + 2] for i in range(len(initials) - 1)))
            cost, audit = solve(bytes(GONE if c >= 16 else c for c in codes))
            gaps = 0 if first is None else last - first + 1 - turns
            out.append((whose[0], gaps, sum(16 <= c < 32 for c in codes), sum(c >= 32 for c in codes), sum(4 <= c < 8 for c in codes), bad, cost, audit))

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = [kind_of, *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", *numbers, "audit"])

        for opens, part, whom in _groups(batches):
            kind_of = part.schema.field(0).type
            if opens:
                if codes:
                    close()
                if len(out) >= 5000:
                    yield emit()
                    out = []
                whose, codes, first, last, turns = whom, bytearray(), None, None, 0
            codes += bytes(part.column(2).to_pylist())
            for turn in part.column(1).to_pylist():
                if turn is not None and turn != last:
                    first = turn if first is None else first
                    last, turns = turn, turns + 1
        if codes:
            close()
        if out:
            yield emit()

    return coded.select("conv_id", "turn", "code").mapInArrow(run, schema)


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: ``conv_id, place, edit, turn, role, text``.

    ``audits`` holds ``conv_id`` and ``audit`` of every conversation of ``rows``. ``place`` counts from 1; inserted
    rows have no turn and an empty text. The rows of a conversation are in one partition, in order.
    """
    heads = audits.select("conv_id", "audit", F.lit(0).alias("body"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "text")], F.lit(None).cast("string").alias("digest"))
    bodies = _plain(rows).select("conv_id", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("body"), "turn", "role", "text", _digest())
    ordered = heads.unionByName(bodies).repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "body", F.col("turn").asc_nulls_first(), "role", "digest"
    )
    schema = T.StructType([
        rows.schema["conv_id"], T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), rows.schema["turn"],
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, audit, at, state, place = [None], "", 0, 0, 0
        out: list[tuple] = []

        def inserts() -> None:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                at, state, place = at + 1, _NEXT[state], place + 1
                out.append((whose[0], place, "I", None, "user" if state == 2 else "assistant", ""))

        for opens, part, whom in _groups(batches):
            kinds = [part.schema.field(0).type, pa.int64(), pa.string(), part.schema.field(2).type, pa.string(), pa.string()]
            if opens:
                inserts()
                whose, audit, at, state, place = whom, "", 0, 0, 0
            for given, turn, role, text in zip(*(part.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                if given is not None:
                    audit = given
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                state = 1 if edit == "K" and role.startswith("s") else _NEXT[state]
                place += 1
                out.append((whose[0], place, edit, turn, role if edit == "K" else "user" if state == 2 else "assistant", text))
            if len(out) >= 2000:
                yield _rows(out, kinds)
                out = []
        inserts()
        if out:
            yield _rows(out, kinds)

    def _rows(out: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema.fieldNames())

    return ordered.select("conv_id", "audit", "turn", "role", "text").mapInArrow(run, schema)


def digests(repaired: DataFrame, in_order: bool = False) -> DataFrame:
    """``conv_id, repaired_sha256``: SHA-256 of the lines ``role:text`` of each conversation that has rows.

    ``in_order``: the rows come straight from ``repaired`` and need no further sort.
    """
    if not in_order:
        repaired = repaired.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "place")
    schema = T.StructType([repaired.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, state, kind_of = [None], None, None
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            ids, sums = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind_of), pa.array(sums, pa.string())], ["conv_id", "repaired_sha256"])

        for opens, part, whom in _groups(batches):
            kind_of = part.schema.field(0).type
            if opens:
                if state is not None:
                    out.append((whose[0], state.hexdigest()))
                if len(out) >= 5000:
                    yield emit()
                    out = []
                whose, state, glue = whom, hashlib.sha256(), b""
            for role, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                state.update(glue + role.encode() + b":")
                state.update(text.encode())
                glue = b"\n"
        if state is not None:
            out.append((whose[0], state.hexdigest()))
            yield emit()

    return repaired.select("conv_id", "role", "text").mapInArrow(run, schema)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The audits of the conversations and their repaired rows. The audits are written once."""
    found = written(audits(rows), "audits")
    return found, repaired(rows, found)


def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults put in by a hash of id and turn: what the query repairs.

    Of crc32 of ``conv_id:turn`` modulo 20, 0 drops a row, 1 empties its text, 2 takes out its ``.!?``, 3 repeats it and
    4 makes its role user.
    """
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.pmod(F.crc32(F.concat_ws(":", *part)), F.lit(20))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        _plain(rows)
        .withColumn("kind", kind)
        .filter("kind <> 0")
        .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
        .drop("copy")
    )
