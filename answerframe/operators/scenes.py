"""What follows within scenes that are small enough to be searched whole: a numpy step over sorted rows.

A batch holds many scenes, which are searched side by side: a round takes one step from all objects
reached in the round before, for all scenes, relations and asked objects at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Kinds of rows: a fact, a fact that also holds turned round, a link of a container to an item, an asked pair.
FACT, FACT_BOTH_WAYS, LINK, ASKED = range(4)
# Bits of a mask: left, right, above, below are followed, the others only looked up.
FOLLOWED = 4


def turned(mask: np.ndarray) -> np.ndarray:
    """The converses of relations in a mask: left and right, above and below change places."""
    return (mask & 0b0101) << 1 | (mask & 0b1010) >> 1 | (mask & ~0b1111)


def _sorted(keys: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return keys[order], to[order]


def _onward(moves: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``at`` that have moves, once for each, and where these lead."""
    keys, to = moves
    low = np.searchsorted(keys, at, side="left")
    n = np.searchsorted(keys, at, side="right") - low
    place = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
    return np.repeat(np.arange(len(at)), n), to[place]


def follows(scene: np.ndarray, a: np.ndarray, b: np.ndarray, kind: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct asked pair a row that asks it, and which of the asked relations follow.

    ``scene`` is a non-decreasing number, ``a`` and ``b`` are numbers of objects. The rules are those of ``pair_reach``.
    """
    names = max(int(a.max()), int(b.max())) + 1
    nodes, place = np.unique(np.concatenate([scene * names + a, scene * names + b]), return_inverse=True)
    a, b, n_nodes = place[: len(a)], place[len(a) :], len(nodes)
    scene_of = nodes // names
    first = np.searchsorted(scene_of, scene_of, side="left")
    held = np.searchsorted(scene_of, scene_of, side="right") - first

    asks = np.flatnonzero(kind == ASKED)
    pairs, row, same = np.unique(a[asks] * n_nodes + b[asks], return_index=True, return_inverse=True)
    wanted = np.zeros(len(pairs), dtype=np.int64)
    np.bitwise_or.at(wanted, same, mask[asks])
    subj, obj = pairs // n_nodes, pairs % n_nodes

    fact, both = kind <= FACT_BOTH_WAYS, kind == FACT_BOTH_WAYS
    start, end = np.concatenate([a[fact], b[both]]), np.concatenate([b[fact], a[both]])
    rels = np.concatenate([mask[fact], turned(mask[both])])
    stated = np.zeros(len(pairs), dtype=np.int64)
    ends = start * n_nodes + end
    known = np.minimum(np.searchsorted(pairs, ends), max(0, len(pairs) - 1))
    hit = pairs[known] == ends if len(pairs) else np.zeros(len(ends), dtype=bool)
    np.bitwise_or.at(stated, known[hit], rels[hit])
    found = wanted & stated

    # One search for each relation and asked subject that a stated fact does not answer yet.
    which, rel = np.nonzero((wanted & ~found)[:, None] >> np.arange(FOLLOWED) & 1)
    searches, own = np.unique(subj[which] * FOLLOWED + rel, return_inverse=True)
    source, of_rel = searches // FOLLOWED, searches % FOLLOWED
    held_by = 2 * held[source]
    shift = np.cumsum(held_by) - held_by - 2 * first[source]
    seen = np.zeros(int(held_by.sum()), dtype=bool)
    has, bit = np.nonzero(rels[:, None] >> np.arange(FOLLOWED) & 1)
    arrows = _sorted(start[has] * FOLLOWED + bit, end[has])
    link = kind == LINK
    up, down = _sorted(b[link], a[link]), _sorted(a[link], b[link])

    # A state is an object and whether a fact has been followed since the last step up.
    search, node, state = np.arange(len(searches)), source, np.zeros(len(searches), dtype=np.int64)
    seen[shift[search] + 2 * node] = True
    while len(search):
        i, to = _onward(arrows, node * FOLLOWED + of_rel[search])
        steps = [(search[i], to, np.ones(len(i), dtype=np.int64))]
        if link.any():
            i, to = _onward(up, node)
            steps.append((search[i], to, np.zeros(len(i), dtype=np.int64)))
            lower = np.flatnonzero(state == 1)
            i, to = _onward(down, node[lower])
            steps.append((search[lower[i]], to, np.ones(len(i), dtype=np.int64)))
        search, node, state = (np.concatenate(x) for x in zip(*steps, strict=True))
        at = shift[search] + 2 * node + state
        fresh = np.flatnonzero(~seen[at])
        at, once = np.unique(at[fresh], return_index=True)
        seen[at] = True
        search, node, state = (x[fresh[once]] for x in (search, node, state))
    reached = seen[shift[own] + 2 * obj[which] + 1]
    np.bitwise_or.at(found, which[reached], 1 << rel[reached])
    return asks[row], found


def _answered(rows: pa.Table, scene: np.ndarray) -> Iterator[pa.RecordBatch]:
    objects = pa.chunked_array([*rows["a"].chunks, *rows["b"].chunks]).combine_chunks().dictionary_encode()
    numbers = objects.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kind, mask = (rows[c].to_numpy().astype(np.int64) for c in ("kind", "mask"))
    row, found = follows(scene, numbers[: len(rows)], numbers[len(rows) :], kind, mask)
    keep = found > 0
    out = rows.select(["story_id", "a", "b"]).take(pa.array(row[keep]))
    yield from out.append_column("mask", pa.array(found[keep].astype(np.int32))).to_batches()


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``story_id, a, b, mask`` of the asked pairs that follow; rows ``story_id, a, b, kind, mask`` come sorted by scene.

    A scene cut by the end of a batch waits for its other rows, so all of it is looked at together.
    """
    waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if waiting is None else pa.concat_tables([waiting, rows]).combine_chunks()
        scene = rows["story_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        whole = int(np.searchsorted(scene, scene[-1]))
        if whole:
            yield from _answered(rows.slice(0, whole), scene[:whole])
        waiting = rows.slice(whole)
    if waiting is not None:
        yield from _answered(waiting, np.zeros(len(waiting), dtype=np.int64))
