"""Relation rules against brute force on small scenes."""

import random

import pytest

from answerframe.constants import INVERSE
from answerframe.operators import relations
from answerframe.operators.relations import (
    ancestors,
    answer_from_facts,
    closed_facts,
    contradictions,
    inherit_direction,
    pair_reach,
    relation_closure,
    relation_symmetry,
)

FACTS = "story_id long, subj string, rel string, obj string"


def _set(frame):
    return {tuple(r) for r in frame.collect()}


def _random_facts(seed, stories=4, n=14):
    rng = random.Random(seed)
    rels = list(INVERSE)
    rows = set()
    for story in range(stories):
        for _ in range(n):
            a, b = rng.sample("abcdefg", 2)
            rows.add((story, a, rng.choice(rels), b))
    return rows


def _closure(rows):
    known = {r for r in rows if r[2] in ("left", "right", "above", "below")}
    while True:
        more = {(s, a, r, d) for s, a, r, b in known for s2, c, r2, d in known if s == s2 and r == r2 and b == c} - known
        if not more:
            return known
        known |= more


def test_symmetry(spark):
    rows = _random_facts(1)
    wanted = rows | {(s, b, INVERSE[r], a) for s, a, r, b in rows}
    assert _set(relation_symmetry(spark.createDataFrame(sorted(rows), FACTS))) == wanted


def test_closure_with_cycles_and_from_sources(spark):
    rows = _random_facts(2)
    wanted = _closure(rows)
    facts = spark.createDataFrame(sorted(rows), FACTS)
    assert _set(relation_closure(facts)) == wanted
    sources = spark.createDataFrame([(0, "a"), (2, "c"), (9, "z")], "story_id long, subj string")
    assert _set(relation_closure(facts, sources)) == {w for w in wanted if (w[0], w[1]) in {(0, "a"), (2, "c")}}
    assert _set(relation_closure(facts.limit(0))) == set()


def test_closure_of_a_chain_takes_few_rounds(spark):
    chain = spark.createDataFrame([(1, f"n{i:02d}", "left", f"n{i + 1:02d}") for i in range(20)], FACTS)
    assert relation_closure(chain).count() == 20 * 21 // 2


def test_inheritance_for_asked_pairs_only(spark):
    blocks = spark.createDataFrame([(1, "A", "left", "B"), (1, "A", "near", "B"), (2, "A", "above", "B")], FACTS)
    holds = spark.createDataFrame([(1, "A", "x"), (1, "B", "y"), (1, "B", "z"), (2, "A", "x"), (2, "B", "y")], "story_id long, container string, item string")
    asked = spark.createDataFrame([(1, "x", "y"), (1, "y", "x"), (2, "x", "y"), (3, "x", "y")], "story_id long, subj string, obj string")
    assert _set(inherit_direction(blocks, holds, asked)) == {(1, "x", "left", "y"), (2, "x", "above", "y")}


def test_contradictions(spark):
    facts = spark.createDataFrame([(1, "a", "near", "b"), (1, "b", "far", "a"), (2, "a", "near", "b"), (2, "a", "left", "b"), (3, "a", "far", "b")], FACTS)
    assert _set(contradictions(facts)) == {(1, "a", "b")}


def test_answers_from_facts(spark):
    facts = relation_symmetry(spark.createDataFrame([(1, "a", "left", "b"), (1, "a", "above", "b"), (1, "c", "near", "b"), (1, "d", "left", "b")], FACTS))
    rows = [
        (1, "fr", "FR", "a", None, "b", []), (1, "fr-dk", "FR", "a", None, "c", []), (1, "yes", "YN", "a", "left", "b", []),
        (1, "no", "YN", "b", "left", "a", []), (1, "no2", "YN", "c", "far", "b", []), (1, "dk", "YN", "a", "touching", "b", []),
        (1, "co0", "CO", None, "above", "b", ["a", "d", "both", "neither"]), (1, "co1", "CO", None, "near", "b", ["a", "c", "both", "neither"]),
        (1, "co2", "CO", None, "left", "b", ["a", "d", "both", "neither"]), (1, "co3", "CO", None, "far", "b", ["a", "d", "both", "neither"]),
        (1, "fb", "FB", None, "left", "b", ["d", "c", "a"]), (1, "fb-none", "FB", None, "far", "b", ["a"]), (1, "fb-empty", "FB", None, "left", "b", []),
        (2, "other", "FR", "a", None, "b", []),
    ]
    asked = spark.createDataFrame(rows, "story_id long, key string, q_type string, subj string, rel string, obj string, candidates array<string>")
    assert {r.key: r.answer for r in answer_from_facts(asked, facts).collect()} == {
        "fr": ["0", "2"], "fr-dk": ["7"], "yes": ["Yes"], "no": ["No"], "no2": ["No"], "dk": ["DK"], "co0": ["0"], "co1": ["1"], "co2": ["2"],
        "co3": ["3"], "fb": ["d", "a"], "fb-none": [], "fb-empty": [], "other": ["7"],
    }


def _follows(facts, contains, asked):
    """All that follows in a scene, by applying every rule until nothing is new."""
    known = set(facts) | {(s, b, INVERSE[r], a) for s, a, r, b in facts}
    lies = set(contains)
    while True:
        more = {(s, a, r, d) for s, a, r, b in known if r in ("left", "right", "above", "below") for s2, c, r2, d in known if (s, r, b) == (s2, r2, c)}
        for s, a, r, b in known:
            if r in ("left", "right", "above", "below"):
                below_a = [a] + [i for s2, c, i in lies if (s2, c) == (s, a)]
                below_b = [b] + [i for s2, c, i in lies if (s2, c) == (s, b)]
                more |= {(s, x, r, y) for x in below_a for y in below_b}
        if more <= known:
            return known & set(asked)
        known |= more


def _scene(seed):
    rng = random.Random(seed)
    nodes = "ABCDabcdef"
    facts = {(s, *rng.sample(nodes, 1), rng.choice(list(INVERSE)), rng.choice(nodes)) for s in range(5) for _ in range(7)}
    # Blocks may hold blocks: A holds B, C holds D, and small letters lie anywhere.
    contains = {(s, rng.choice("ABCD"), rng.choice("abcdef")) for s in range(5) for _ in range(4)}
    contains |= {(s, "A", "B") for s in range(3)} | {(s, "C", "D") for s in range(5)} | {(4, "B", "C")}
    asked = {(s, rng.choice(nodes), rng.choice(list(INVERSE)), rng.choice(nodes)) for s in range(6) for _ in range(60)}
    return sorted(facts), sorted(contains), sorted(asked)


@pytest.mark.parametrize("seed", range(3))
def test_closed_facts_against_all_rules(spark, seed):
    facts, contains, asked = _scene(seed)
    found = closed_facts(
        spark.createDataFrame(facts, FACTS), spark.createDataFrame(contains, "story_id long, container string, item string"), spark.createDataFrame(asked, FACTS)
    )
    assert _set(found) == _follows(facts, contains, asked)


def test_pair_reach_against_closure_with_split_nodes(spark):
    rows = _random_facts(5, stories=3, n=30)
    facts = spark.createDataFrame(sorted(rows), FACTS)
    asked = [(s, a, r, b) for s in range(4) for a in "abcdefg" for r in ("left", "above", "near") for b in "abcdefg"]
    want = _closure(rows) & set(asked)
    for per_part in (100_000, 1):
        assert _set(pair_reach(facts, spark.createDataFrame(asked, FACTS), per_part=per_part)) == want
    assert pair_reach(facts.limit(0), spark.createDataFrame(asked, FACTS)).count() == 0
    assert pair_reach(facts, spark.createDataFrame([], FACTS)).count() == 0


def test_pair_reach_takes_half_the_rounds(spark, monkeypatch):
    frontiers = []
    real = relations.written
    monkeypatch.setattr(relations, "written", lambda df, name: frontiers.append(name) or real(df, name))
    chain = spark.createDataFrame([(1, f"n{i:02d}", "left", f"n{i + 1:02d}") for i in range(12)], FACTS)
    asked = spark.createDataFrame([(1, "n00", "left", "n12"), (1, "n12", "left", "n00"), (1, "n05", "left", "n06"), (1, "n03", "left", "n03")], FACTS)
    assert _set(pair_reach(chain, asked)) == {(1, "n00", "left", "n12"), (1, "n05", "left", "n06")}
    assert frontiers.count("met") == 6


@pytest.mark.parametrize("depth", [1, 2, 10])
def test_inherit_through_nested_blocks(spark, monkeypatch, depth):
    rounds = []
    real = relations.written
    monkeypatch.setattr(relations, "written", lambda df, name: rounds.append(name) or real(df, name))
    nested = [(7, f"{s}{i}", f"{s}{i + 1}") for s in "xy" for i in range(depth)]
    contains = spark.createDataFrame([*nested, (7, "x0", "other")], "story_id long, container string, item string")
    blocks = spark.createDataFrame([(7, "x0", "left", "y0"), (7, "x0", "near", "y0")], FACTS)
    asked = spark.createDataFrame([(7, f"x{depth}", f"y{depth}"), (7, f"y{depth}", f"x{depth}"), (7, "x0", "y0")], "story_id long, subj string, obj string")
    assert _set(inherit_direction(blocks, contains, asked)) == {(7, f"x{depth}", "left", f"y{depth}")}
    assert rounds.count("ancestors") <= depth.bit_length() + 2


def test_containment_in_a_circle_ends(spark):
    links = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a")], "story_id long, container string, item string")
    assert ancestors(links, links.select("story_id", "item")).count() == 9
