"""Scenes searched within a task: as by joins and by brute force, at any bound, without a shuffle for each round."""

import random

import pytest

from answerframe.operators import relations
from answerframe.operators.relations import closed_facts, pair_reach

FACTS = "story_id long, subj string, rel string, obj string"
LINKS = "story_id long, container string, item string"
DIRECTED = ("left", "right", "above", "below")


def _rows(df):
    got = [(r.story_id, r.subj, r.rel, r.obj) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def _given(spark, seed, stories=6):
    rng = random.Random(seed)
    nodes, rels = "ABCabcdef", (*DIRECTED, "near", "far", "touching")
    facts = [(s, rng.choice(nodes), rng.choice(rels), rng.choice(nodes)) for s in range(stories) for _ in range(4 + 2 * s)]
    links = [(s, rng.choice("ABC"), rng.choice("Babcdef")) for s in range(stories) for _ in range(s % 5)]
    asked = [(s, rng.choice(nodes), rng.choice(rels), rng.choice(nodes)) for s in range(stories + 1) for _ in range(25)]
    facts += facts[:9] + [(None, "a", "left", "b"), (1, None, "left", "b"), (1, "a", None, "b")]
    asked += asked[:9] + [(None, "a", "left", "b"), (1, "a", "left", None)]
    return spark.createDataFrame(facts, FACTS), spark.createDataFrame(links + links[:3], LINKS), spark.createDataFrame(asked, FACTS)


@pytest.mark.parametrize("linked", [False, True])
def test_scenes_at_any_bound(spark, linked):
    facts, links, asked = _given(spark, 3)
    links = links if linked else None
    want = _rows(pair_reach(facts, asked, links))
    assert want
    for bound in (36, 1_000):
        assert _rows(pair_reach(facts, asked, links, scene_rows=bound)) == want
    several = asked.groupBy("story_id", "subj", "obj").agg(relations.F.collect_list("rel").alias("rel"))
    assert _rows(pair_reach(facts, several, links, scene_rows=1_000)) == want == _rows(pair_reach(facts, several, links))


def test_closed_facts_at_any_bound(spark):
    facts, links, asked = _given(spark, 4)
    want = _rows(closed_facts(facts, links, asked, scene_rows=0))
    assert {r for _, _, r, _ in want} >= {"above", "touching"}
    for bound in (38, 1_000):
        assert _rows(closed_facts(facts, links, asked, scene_rows=bound)) == want


def test_long_paths_take_no_table_each(spark, monkeypatch):
    tables = []
    real = relations.written
    monkeypatch.setattr(relations, "written", lambda df, name: tables.append(name) or real(df, name))
    chain = spark.createDataFrame([(s, f"n{i:03d}", "left", f"n{i + 1:03d}") for s in range(40) for i in range(150)], FACTS)
    pairs = [(s, "n000", "left", "n150") for s in range(40)] + [(s, "n150", "left", "n000") for s in range(40)]
    asked = spark.createDataFrame(pairs + [(s, "n150", "right", "n000") for s in range(40)], FACTS)
    assert _rows(pair_reach(chain, asked, scene_rows=500)) == {(s, "n000", "left", "n150") for s in range(40)}
    assert _rows(closed_facts(chain, chain.selectExpr("story_id", "'box' container", "subj item").limit(0), asked)) == {
        x for s in range(40) for x in ((s, "n000", "left", "n150"), (s, "n150", "right", "n000"))
    }
    assert len(tables) == 4


def test_empty_scenes(spark):
    facts, links, asked = _given(spark, 5)
    for f, q in ((facts.limit(0), asked), (facts, asked.limit(0)), (facts.limit(0), asked.limit(0))):
        assert pair_reach(f, q, scene_rows=500).count() == 0
    assert closed_facts(facts.limit(0), links.limit(0), asked).count() == 0
