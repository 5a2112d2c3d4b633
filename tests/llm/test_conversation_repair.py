"""Conversation repair against trying all suffixes, and the query against its SQL on awkward rows."""

import hashlib
import random
import re

import duckdb
import pytest

from answerframe.llm import conversation_repair as repair
from answerframe.llm.oracles import ORACLES

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(codes):
    """Least (cost, audit) by whole suffixes, from the last row on."""
    after = None
    for i in range(len(codes), -1, -1):
        now = {}
        for q in range(4):
            options = [(0, "")] if after is None and q in (0, 3) else []
            if after is not None:
                for edit in "DKR":
                    step = repair._step(codes[i], q, edit)
                    if step:
                        options.append((after[step[0]][0] + step[1], edit + after[step[0]][1]))
            now[q] = min(options, default=(10**9, ""))
        for _ in range(4):
            now = {q: min(now[q], (now[repair._NEXT[q]][0] + 3, "I" + now[repair._NEXT[q]][1])) for q in now}
        after = now
    return after[0]


@pytest.mark.parametrize("seed", range(4))
def test_cheapest(seed):
    rng = random.Random(seed)
    for n in [*range(12)] * 60 + [50, 130]:
        codes = bytes(rng.choices([0, 1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 1, 2], k=n))
        assert repair.cheapest(codes) == plain(codes)


def test_long_conversation_ends():
    cost, audit = repair.cheapest(bytes([1, 2, 8]) * 10_000)
    assert (cost, audit) == (40_000, "KKD" * 10_000)


def made_up(seed, n=400):
    rng = random.Random(seed)
    words = ["Yes.", "no", " ", "", "\t\n", "ok!", "ok! ", None, "why?\n", "zé", "日本."]
    rows = {}
    for _ in range(n):
        conv, turn = rng.choice([None, *range(40), 2**53 + 1]), rng.choice([None, *range(9), 2**40])
        rows[conv, turn] = (conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(words))
    return list(rows.values())


@pytest.mark.parametrize("seed", range(3))
def test_query_equals_sql_on_awkward_rows(spark, tmp_path, seed):
    from answerframe.llm.queries import QUERIES

    frame = spark.createDataFrame(made_up(seed), SCHEMA)
    frame.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    found = QUERIES["op13_repair_conversations"](spark, str(tmp_path))
    sql = duckdb.connect()
    sql.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    cursor = sql.execute(ORACLES["op13_repair_conversations"])
    names = [d[0] for d in cursor.description]
    assert names == found.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_operator_gives_whole_conversations(spark):
    rows = made_up(9) + [(500, i, ["user", "assistant"][i % 2], f"turn {i}." + "long " * 2000 + ".") for i in range(300)]
    frame = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA + ", audit string, cost int")
    audits, mended = repair.repair(frame)
    by_conv = {}
    for r in mended.orderBy("conv_id", "place").collect():
        by_conv.setdefault(r.conv_id, []).append(r)
    for a in audits.collect():
        given = by_conv.get(a.conv_id, [])
        assert [r.place for r in given] == list(range(1, len(given) + 1))
        assert "".join(r.edit for r in given) == a.audit.replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in given))
        assert all(r.text == "" and r.turn is None for r in given if r.edit == "I")
    assert len(by_conv[500]) == 300
    one = {r.conv_id: r.repaired_sha256 for r in repair.digests(mended).collect()}
    assert one == {r.conv_id: r.repaired_sha256 for r in repair.digests(mended, in_order=True).collect()}
    assert one == {c: hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in rs).encode()).hexdigest() for c, rs in by_conv.items()}


def test_ties_and_storage_do_not_matter(spark):
    rows = [(1, 0, r, t) for r in ("user", "assistant") for t in ("b.", "a.")] * 2 + [(1, None, "system", "s.")]
    frame = spark.createDataFrame(rows, SCHEMA)
    results = [[sorted(map(tuple, df.collect())) for df in repair.repair(frame.orderBy("text", "role").repartition(n))] for n in (1, 4)]
    assert results[0] == results[1]
    (audit,) = results[0][0]
    assert audit[3] == 4


def test_empty_table(spark):
    audits, mended = repair.repair(spark.createDataFrame([], SCHEMA))
    assert audits.count() == mended.count() == repair.digests(mended).count() == 0
