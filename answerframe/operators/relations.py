"""Rules over given spatial facts ``(story_id, subj, rel, obj)``.

These rules are ones the task's instructions state for a model to follow; here they are
joins and aggregates over facts that are already extracted. Where a rule could pair every
object of a scene with every other, it is evaluated for the pairs that are asked.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F, types as T

from answerframe.constants import CONTRADICTS, DIRECTIONAL, FR_DK, INVERSE, RELATIONS
from answerframe.operators import scenes
from answerframe.session import written

FACT = ("story_id", "subj", "rel", "obj")


def _lookup(pairs: dict, column: Column) -> Column:
    entries = [F.lit(x) for pair in pairs.items() for x in pair]
    return F.element_at(F.create_map(*entries), column)


def with_converses(facts: DataFrame) -> DataFrame:
    """Facts and their converses: left/right and above/below turn over, the rest are symmetric.

    One pass and no shuffle; a fact may come up more than once.
    """
    turned = F.struct(
        F.col("obj").alias("subj"), _lookup(INVERSE, F.col("rel")).alias("rel"), F.col("subj").alias("obj")
    )
    return (
        facts.filter(F.col("rel").isin(*RELATIONS))
        .select("story_id", F.explode(F.array(F.struct("subj", "rel", "obj"), turned)).alias("f"))
        .select("story_id", "f.subj", "f.rel", "f.obj")
    )


def relation_symmetry(facts: DataFrame) -> DataFrame:
    """``with_converses``, each fact once."""
    return with_converses(facts).distinct()


def relation_closure(facts: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Transitive closure of the four directional relations, within story and relation.

    ``sources`` (``story_id, subj``) keeps what can be reached from the asked objects only,
    which is what questions need and grows with the questions instead of with all pairs of
    a scene. Then a round adds one step; without it a round doubles the path length.
    Each round joins only what the round before found, and is written to the shared
    folder, so plans stay short and a lost executor re-reads files. The driver learns
    only whether a round was empty.
    """
    edges = written(facts.filter(F.col("rel").isin(*DIRECTIONAL)).select(*FACT).distinct(), "edges")
    found = edges
    if sources is not None:
        found = written(edges.join(sources.select("story_id", "subj").distinct(), ["story_id", "subj"], "left_semi"), "reach")
    reach = found.select(*FACT)
    while True:
        onward = (reach if sources is None else edges).select(
            "story_id", "rel", F.col("subj").alias("via"), F.col("obj").alias("to")
        )
        step = (
            found.withColumnRenamed("obj", "via")
            .join(onward, ["story_id", "rel", "via"])
            .select("story_id", "subj", "rel", F.col("to").alias("obj"))
            .distinct()
            .join(reach, list(FACT), "left_anti")
            .select(*FACT)
        )
        found = written(step, "reach")
        if found.isEmpty():
            return reach
        reach = reach.unionByName(found)


_PAIR = ["story_id", "subj", "rel", "obj"]
# A node with more arrows than this has them in several parts, each a join key of its own.
ARROWS_PER_PART = 100_000
# Rounds after which what was seen so far is written as one table.
MERGE_EVERY = 4
# A scene with more rows (facts, links and asked pairs) than this is searched by joins, one with fewer within a task.
SCENE_ROWS = 500


def ancestors(contains: DataFrame, items: DataFrame) -> DataFrame:
    """``story_id, item, container``: everything the given items lie in, at any depth.

    ``contains``: ``story_id, container, item``; ``items``: ``story_id, item``. Parent links are doubled in
    every round (links to the 2nd, 4th, 8th container), so a depth of n takes about log2(n) rounds, and what
    is kept are the ancestors of the given items only. An item may lie in several containers. A containment
    that runs in a circle ends too: nothing new is found.
    """
    jumps = written(contains.select("story_id", "item", "container").distinct(), "jumps")
    found = written(jumps.join(items.select("story_id", "item").distinct(), ["story_id", "item"], "left_semi"), "ancestors")
    while True:
        onward = jumps.select("story_id", F.col("item").alias("container"), F.col("container").alias("above"))
        step = found.join(onward, ["story_id", "container"]).select("story_id", "item", F.col("above").alias("container"))
        more = written(step.distinct().join(found, ["story_id", "item", "container"], "left_anti"), "ancestors")
        if more.isEmpty():
            return found
        found = found.unionByName(more)
        doubled = jumps.join(onward, ["story_id", "container"]).select("story_id", "item", F.col("above").alias("container"))
        jumps = written(doubled.distinct(), "jumps")


def inherit_direction(block_facts: DataFrame, contains: DataFrame, asked: DataFrame) -> DataFrame:
    """Directions that asked objects inherit from the blocks they lie in, at any depth of containment.

    ``contains``: ``story_id, container, item``; ``asked``: ``story_id, subj, obj``. Only the
    asked pairs are looked at, never all pairs of two blocks.
    """
    pairs = asked.select("story_id", "subj", "obj").distinct()
    objects = pairs.select("story_id", F.explode(F.array("subj", "obj")).alias("item"))
    above = ancestors(contains, objects)
    of_subj = above.select("story_id", F.col("item").alias("subj"), F.col("container").alias("subj_block"))
    of_obj = above.select("story_id", F.col("item").alias("obj"), F.col("container").alias("obj_block"))
    blocks = block_facts.filter(F.col("rel").isin(*DIRECTIONAL)).select(
        "story_id", F.col("subj").alias("subj_block"), "rel", F.col("obj").alias("obj_block")
    )
    return (
        pairs.join(of_subj, ["story_id", "subj"])
        .join(of_obj, ["story_id", "obj"])
        .join(blocks, ["story_id", "subj_block", "obj_block"])
        .select(*FACT)
        .distinct()
    )


def _arrows(facts: DataFrame, per_part: int) -> tuple[DataFrame, DataFrame]:
    """Facts as arrows in both directions, those of large nodes in parts; and the large nodes."""
    ways = F.explode(
        F.array(
            F.struct(F.lit(0).alias("side"), F.col("subj").alias("node"), F.col("obj").alias("to")),
            F.struct(F.lit(1).alias("side"), F.col("obj").alias("node"), F.col("subj").alias("to")),
        )
    )
    both = facts.filter(F.col("rel").isin(*DIRECTIONAL)).select(*FACT).distinct().select("story_id", "rel", ways.alias("w"))
    both = written(both.select("story_id", "rel", "w.side", "w.node", "w.to"), "arrows")
    at = ["story_id", "rel", "side", "node"]
    large = both.groupBy(*at).count().filter(F.col("count") > per_part)
    large = written(large.select(*at, F.ceil(F.col("count") / per_part).cast("int").alias("parts")), "large")
    part = F.pmod(F.xxhash64("to"), F.coalesce("parts", F.lit(1))).cast("int")
    return both.join(large, at, "left").select(*at, part.alias("part"), "to"), large


def _ties(contains: DataFrame, facts: DataFrame) -> DataFrame:
    """Moves along containment: ``story_id, side, node, need, to, states``.

    Upwards every item moves. Downwards only those can help from which a path goes on: objects of
    facts, objects in several containers, and what holds such objects.
    """
    links = written(contains.select("story_id", "container", "item").distinct(), "links")
    named = facts.select("story_id", F.explode(F.array("subj", "obj")).alias("item"))
    shared = links.groupBy("story_id", "item").count().filter("count > 1").select("story_id", "item")
    active = named.unionByName(shared).distinct()
    active = active.unionByName(ancestors(links, active).select("story_id", F.col("container").alias("item"))).distinct()
    below = links.join(written(active, "active"), ["story_id", "item"], "left_semi")

    def move(rows: DataFrame, side: int, start: str, need: int | None, to: str, states: tuple[int, ...]) -> DataFrame:
        return rows.select(
            "story_id", F.lit(side).alias("side"), F.col(start).alias("node"), F.lit(need).cast("int").alias("need"),
            F.col(to).alias("to"), F.array(*map(F.lit, states)).alias("states"),
        )

    moves = [
        move(links, 0, "item", None, "container", (0,)),
        move(below, 0, "container", 1, "item", (1,)),
        move(links, 1, "item", 1, "container", (1,)),
        move(below, 1, "container", 0, "item", (0, 1)),
    ]
    return written(moves[0].unionByName(moves[1]).unionByName(moves[2]).unionByName(moves[3]), "ties")


def _masks(rel: Column, kind: T.DataType) -> Column:
    """Bits of the relations in ``rel``, a name or an array of names; 0 if there are none."""
    has = (lambda r: F.array_contains(rel, r)) if isinstance(kind, T.ArrayType) else (lambda r: rel == r)
    bits = [F.when(has(r), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RELATIONS)]
    return functools.reduce(lambda x, y: x.bitwiseOR(y), bits)


def _named(rows: DataFrame) -> DataFrame:
    """``story_id, a, b, mask`` as facts, one for each bit."""
    names = F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.lit(r)) for i, r in enumerate(RELATIONS)]))
    return rows.select("story_id", F.col("a").alias("subj"), F.explode(names).alias("rel"), F.col("b").alias("obj")).select(*FACT)


def _in_scenes(
    facts: DataFrame, asked: DataFrame, contains: DataFrame | None, scene_rows: int, both_ways: bool
) -> tuple[DataFrame, tuple[DataFrame, DataFrame, DataFrame | None] | None]:
    """What follows in scenes of at most ``scene_rows`` rows; and facts, asked pairs and links of the larger scenes, if any.

    Only rows of small scenes meet by scene, so a task never holds more of one scene than that. ``both_ways``: facts
    hold turned round, too. The driver learns only whether there is a larger scene.
    """

    def part(df: DataFrame, a: str, b: str, kind: int, mask: Column) -> DataFrame:
        rows = df.select("story_id", F.col(a).alias("a"), F.col(b).alias("b"), F.lit(kind).cast("tinyint").alias("kind"), mask.cast("int").alias("mask"))
        return rows.dropna(subset=["story_id", "a", "b"])

    stated, wanted = (_masks(F.col("rel"), df.schema["rel"].dataType) for df in (facts, asked))
    rows = part(facts, "subj", "obj", scenes.FACT_BOTH_WAYS if both_ways else scenes.FACT, stated).filter("mask > 0")
    rows = rows.unionByName(part(asked, "subj", "obj", scenes.ASKED, wanted).filter("mask > 0"))
    if contains is not None:
        rows = rows.unionByName(part(contains, "container", "item", scenes.LINK, F.lit(0)))
    rows = written(rows, "scenes")
    large = written(rows.groupBy("story_id").count().filter(F.col("count") > scene_rows).select("story_id"), "large-scenes")
    rest = None
    if not large.isEmpty():
        other = rows.join(large, "story_id", "left_semi")
        kept = lambda kinds: _named(other.filter(F.col("kind").isin(*kinds)))
        links = other.filter(F.col("kind") == scenes.LINK).select("story_id", F.col("a").alias("container"), F.col("b").alias("item"))
        rest = kept([scenes.FACT, scenes.FACT_BOTH_WAYS]), kept([scenes.ASKED]), None if contains is None else links
        rows = rows.join(large, "story_id", "left_anti")
    schema = T.StructType([rows.schema[c] for c in ("story_id", "a", "b", "mask")])
    found = rows.repartition("story_id").sortWithinPartitions("story_id").mapInArrow(scenes.answered, schema)
    types = {f.name: f.dataType for f in asked.schema.fields if f.name != "rel"}
    return _named(found).select(*[F.col(c).cast(types[c]).alias(c) if c in types else c for c in FACT]), rest


def pair_reach(
    facts: DataFrame, asked: DataFrame, contains: DataFrame | None = None, per_part: int = ARROWS_PER_PART, scene_rows: int = 0
) -> DataFrame:
    """The asked pairs (``story_id, subj, rel, obj``) that follow from directional facts of the same story and relation.

    A pair follows if a path of facts leads from subj to obj. With ``contains`` (``story_id, container, item``) a
    path may also go up from an object to what holds it before a fact and down after one, since what blocks hold
    inherits their direction; so a node is an object and whether a fact has been followed since the last step up.
    ``rel`` of the asked pairs may be an array: several relations asked in one row.

    Scenes of at most ``scene_rows`` rows are shuffled once and searched within a task, many at a time. All others are
    searched by joins, from both ends, a step each in a round, asking whether they have met: as many rounds as
    half the longest path. A round joins only what the round before found. Pairs that have met leave, as
    do those of which one end finds nothing new. A node of very many facts is several join keys.
    The driver learns only whether a round was empty.
    """
    facts = facts.filter(F.col("rel").isin(*DIRECTIONAL))
    several = isinstance(asked.schema["rel"].dataType, T.ArrayType)
    directional = F.array(*map(F.lit, DIRECTIONAL))
    asked = asked.withColumn("rel", F.array_intersect("rel", directional)) if several else asked.filter(F.col("rel").isin(*DIRECTIONAL))
    if scene_rows:
        found, rest = _in_scenes(facts, asked, contains, scene_rows, both_ways=False)
        return found if rest is None else found.unionByName(_search(*rest, per_part))
    return _search(facts, asked.withColumn("rel", F.explode("rel")) if several else asked, contains, per_part)


def _search(facts: DataFrame, asked: DataFrame, contains: DataFrame | None, per_part: int) -> DataFrame:
    """``pair_reach`` by joins, for scenes of any size."""
    arrows, large = _arrows(facts, per_part)
    arrows = written(arrows, "arrows")
    ties = None if contains is None else _ties(contains, facts.filter(F.col("rel").isin(*DIRECTIONAL)))
    wanted = written(asked.filter(F.col("rel").isin(*DIRECTIONAL)).select(*_PAIR).distinct(), "asked")
    ends = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("node"), F.lit(i).alias("state")) for i, c in enumerate(("subj", "obj"))]))
    row = [*_PAIR, "side", "node", "state"]
    frontier = written(wanted.select(*_PAIR, ends.alias("e")).select(*_PAIR, "e.side", "e.node", "e.state"), "frontier")
    seen, reached, rounds = frontier, None, 0
    while not frontier.isEmpty():
        split = frontier.join(large, ["story_id", "rel", "side", "node"], "left").withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        )
        # Forward a fact leads to state 1; backward it may have been entered in either.
        entered = F.explode(F.when(F.col("side") == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1))))
        step = split.filter("side = 0 or state = 1").join(arrows, ["story_id", "rel", "side", "node", "part"])
        step = step.select(*_PAIR, "side", F.col("to").alias("node"), entered.alias("state"))
        if ties is not None:
            tied = frontier.join(ties, ["story_id", "side", "node"]).filter("need is null or need = state")
            step = step.unionByName(tied.select(*_PAIR, "side", F.col("to").alias("node"), F.explode("states").alias("state")))
        new = written(step.distinct().join(seen, row, "left_anti").select(*row), "frontier")
        seen = seen.unionByName(new)
        other = seen.select(*_PAIR, (1 - F.col("side")).alias("side"), "node", "state")
        met = written(new.join(other, row, "left_semi").select(*_PAIR).distinct(), "met")
        reached = met if reached is None else reached.unionByName(met)
        both = new.groupBy(*_PAIR).agg(F.count_distinct("side").alias("ends")).filter("ends = 2").select(*_PAIR)
        open_pairs = both.join(met, _PAIR, "left_anti")
        frontier = written(new.join(open_pairs, _PAIR, "left_semi").select(*row), "frontier")
        rounds += 1
        if rounds % MERGE_EVERY == 0:
            seen, reached = written(seen.join(frontier.select(*_PAIR).distinct(), _PAIR, "left_semi"), "seen"), written(reached, "reached")
    return wanted.limit(0) if reached is None else reached


def contradictions(facts: DataFrame) -> DataFrame:
    """Pairs, in either order, that are stated to be both near and far."""
    pair = facts.filter(F.col("rel").isin("near", "far")).select(
        "story_id", F.least("subj", "obj").alias("a"), F.greatest("subj", "obj").alias("b"), "rel"
    )
    return (
        pair.groupBy("story_id", "a", "b")
        .agg(F.bool_or(F.col("rel") == "near").alias("near"), F.bool_or(F.col("rel") == "far").alias("far"))
        .filter("near AND far")
        .select("story_id", "a", "b")
    )


def answer_from_facts(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """Answers that given (closed) facts support. Facts may be repeated.

    ``asked``: ``story_id, key, q_type, subj, rel, obj, candidates``. FR lists every
    relation of (subj, obj), or DK alone; YN asks whether ``subj rel obj`` holds, is
    contradicted, or neither; CO and FB ask which candidates stand in ``rel`` to obj.
    Facts meet questions on story and both objects, so one large scene is spread over tasks.
    """
    bit_of = {name: 1 << i for i, name in enumerate(RELATIONS)}
    held = (
        facts.filter(F.col("rel").isin(*RELATIONS))
        .groupBy("story_id", F.col("subj").alias("probe"), "obj")
        .agg(F.bit_or(_lookup(bit_of, F.col("rel"))).alias("mask"))
    )
    wanted = _lookup(bit_of, F.col("rel"))
    against = F.coalesce(_lookup({r: bit_of[c] for r, c in CONTRADICTS.items()}, F.col("rel")), F.lit(0))
    mask = F.coalesce("mask", F.lit(0))
    where = ["story_id", "probe", "obj"]

    # One pair to look up: a join, and nothing to gather.
    relations = F.array_compact(
        F.array(*[F.when(mask.bitwiseAND(1 << i) != 0, F.lit(str(i))) for i in range(len(RELATIONS))])
    )
    verdict = F.when(mask.bitwiseAND(wanted) != 0, "Yes").when(mask.bitwiseAND(against) != 0, "No").otherwise("DK")
    about_pair = (
        asked.filter(F.col("q_type").isin("FR", "YN"))
        .withColumnRenamed("subj", "probe")
        .join(held, where, "left")
        .select(
            "story_id",
            "key",
            "q_type",
            F.when(F.col("q_type") == "YN", F.array(verdict))
            .when(mask == 0, F.array(F.lit(str(FR_DK))))
            .otherwise(relations)
            .alias("answer"),
        )
    )

    # Several candidates: one row each, then as many rows to gather as a question has candidates.
    subjects = F.when(F.col("q_type") == "CO", F.slice("candidates", 1, 2)).otherwise(F.col("candidates"))
    holding = F.when(mask.bitwiseAND(wanted) != 0, F.struct("pos", "probe"))
    chosen = (
        asked.filter(F.col("q_type").isin("CO", "FB"))
        .select("story_id", "key", "q_type", "rel", "obj", F.posexplode_outer(subjects).alias("pos", "probe"))
        .join(held, where, "left")
        .groupBy("story_id", "key", "q_type")
        .agg(F.sort_array(F.collect_list(holding)).alias("chosen"))
    )
    places = F.transform("chosen", lambda c: c["pos"])
    outcome = (
        F.when(F.size("chosen") == 2, "2")
        .when(F.array_contains(places, 0), "0")
        .when(F.array_contains(places, 1), "1")
        .otherwise("3")
    )
    about_candidates = chosen.select(
        "story_id",
        "key",
        "q_type",
        F.when(F.col("q_type") == "CO", F.array(outcome))
        .otherwise(F.transform("chosen", lambda c: c["probe"]))
        .alias("answer"),
    )
    return about_pair.unionByName(about_candidates)


def _probe_rows(asked: DataFrame) -> DataFrame:
    """``story_id, subj, rel, obj`` of the facts that can bear on asked questions; ``rel`` is an array. Rows may be repeated.

    FR asks for every relation of its pair, YN for its own and for the one that contradicts it, CO and FB
    for that of each candidate.
    """
    subjects = (
        F.when(F.col("q_type") == "CO", F.slice("candidates", 1, 2))
        .when(F.col("q_type") == "FB", F.col("candidates"))
        .otherwise(F.array("subj"))
    )
    against = F.array_compact(F.array(F.col("rel"), _lookup(CONTRADICTS, F.col("rel"))))
    relations = (
        F.when(F.col("q_type") == "FR", F.array(*map(F.lit, RELATIONS)))
        .when(F.col("q_type") == "YN", against)
        .otherwise(F.array("rel"))
    )
    return asked.select("story_id", "obj", relations.alias("rel"), F.explode(subjects).alias("subj")).select(*FACT)


def probes(asked: DataFrame) -> DataFrame:
    """``story_id, subj, rel, obj``: the facts that can bear on asked questions, and no others."""
    return _probe_rows(asked).withColumn("rel", F.explode("rel")).distinct()


def closed_facts(facts: DataFrame, contains: DataFrame, demanded: DataFrame, scene_rows: int = SCENE_ROWS) -> DataFrame:
    """Of the demanded facts those that follow by all rules: converses, transitivity, symmetry and containment.

    ``rel`` of the demanded facts may be an array. Near, far and touching are symmetric and never transitive. Scenes of at
    most ``scene_rows`` rows are searched within a task (see ``pair_reach``), larger ones by joins.
    """
    found, rest = _in_scenes(facts, demanded, contains, scene_rows, both_ways=True)
    return found if rest is None else found.unionByName(_closed_by_joins(*rest))


def _closed_by_joins(facts: DataFrame, demanded: DataFrame, contains: DataFrame) -> DataFrame:
    """``closed_facts`` for scenes of any size.

    Of each two converse relations one is searched for (left and above), with facts and demands turned
    round where needed, so converses cost no step.
    """
    turn = F.col("rel").isin("right", "below")
    straight = [
        "story_id", F.when(turn, F.col("obj")).otherwise(F.col("subj")).alias("subj"),
        F.when(turn, _lookup(INVERSE, F.col("rel"))).otherwise(F.col("rel")).alias("rel"),
        F.when(turn, F.col("subj")).otherwise(F.col("obj")).alias("obj"),
    ]
    wanted = demanded.select(*_PAIR).distinct()
    reached = pair_reach(facts.select(*straight), wanted.select(*straight), contains)
    # A demanded fact is answered by its own search or, turned round, by that of its converse.
    directed = with_converses(reached).join(wanted, _PAIR, "left_semi")
    stated = with_converses(facts.filter(~F.col("rel").isin(*DIRECTIONAL))).join(wanted, _PAIR, "left_semi")
    return directed.unionByName(stated).select(*FACT).distinct()


def answer_from_closed_facts(asked: DataFrame, facts: DataFrame, contains: DataFrame) -> DataFrame:
    """``answer_from_facts`` over what follows from the facts by all rules, derived for the asked questions only."""
    return answer_from_facts(asked, closed_facts(facts, contains, _probe_rows(asked)))
