"""Documents read in blocks, and stories of several records written as one."""

import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from answerframe.operators.export import export_predictions
from answerframe.sources.documents import _after, _Cutter
from answerframe.sources.questions import flatten, read_documents
from answerframe.sources.sinks import write_documents

AWKWARD = ["a}b", '{"', "\\", 'x\\"}', "[,]:", "é}", "", '"data":[', "}}}", "\n", 1, 2.5, None, True]


def _value(rng, depth=0):
    kind = rng.random()
    if depth > 3 or kind < 0.4:
        return rng.choice(AWKWARD)
    if kind < 0.7:
        return [_value(rng, depth + 1) for _ in range(rng.randrange(5))]
    return {rng.choice(["k}", "data", "name", "q", '"']): _value(rng, depth + 1) for _ in range(rng.randrange(5))}


def _document(rng, n):
    parts = [
        ("name", rng.choice(["n}a", '{x"\\', None, "data", 7])), ("data", [_value(rng) for _ in range(n)]),
        ("meta", [{"a": 1}, {"data": [1, 2, {}]}]), ("z}", "q}"), ("w", {"data": [3]}),
    ]
    rng.shuffle(parts)
    return dict(rng.sample(parts, rng.randint(1, 5)))


def _elements(text, per_block):
    """What the cutter finds in a text of blocks, put together as the reader does."""
    records = text.split("}")
    records = records[:-1] if records[-1] == "" else records
    inside, depth, rows = False, 0, []
    for block in range(0, len(records), per_block):
        cutter = _Cutter(("f", block), inside, depth)
        for record in records[block : block + per_block]:
            rows += cutter.feed(record + "}")
            inside, deeper = _after(record + "}", inside)
            depth += deeper
        rows += cutter.end()
        assert (cutter.inside, cutter.depth) == (inside, depth)
    of, before, start = None, 0, {}
    for _, block, region, key, commas, *_ in sorted((r for r in rows if r[8] is None), key=lambda r: r[1:3]):
        of = of if key is None else key
        assert (block, region) not in start
        start[block, region] = (of, before)
        before += commas if of == "data" else 0
    found = {}
    for _, block, region, _, commas, seq, _, _, piece in rows:
        if piece is not None and start[block, region][0] == "data":
            found.setdefault(start[block, region][1] + commas, []).append((block, seq, piece))
    return {i: json.loads("".join(p for *_, p in sorted(pieces))) for i, pieces in found.items()}


@pytest.mark.parametrize("seed", range(30))
def test_elements_at_any_cut(seed):
    rng = random.Random(seed)
    document = _document(rng, rng.randrange(25))
    text = json.dumps(document, ensure_ascii=bool(seed % 2), indent=rng.choice([None, 2])) + rng.choice(["", "\n", "  \n"])
    want = dict(enumerate(document.get("data") or []))
    for per_block in (1, 2, 7, 10_000):
        assert _elements(text, per_block) == want


def test_files_in_blocks(spark, tmp_path):
    rng = random.Random(7)
    documents = {f"f{k}": _document(rng, 40) for k in range(4)}
    documents |= {"none": {"name": "x"}, "empty": {"data": []}, "null": {"name": None, "data": [{"story": "a}"}]}}
    for stem, document in documents.items():
        (tmp_path / f"{stem}.json").write_text(json.dumps(document, ensure_ascii=False), encoding="utf-8")
    settings = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in settings}
    found = {}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "f0.json")).rdd.getNumPartitions() > 1
        rows = read_documents(spark, [str(tmp_path / f"{s}.json") for s in documents])
        for r in rows.selectExpr("*", "to_json(item) as text").collect():
            found.setdefault(r.source_file.split("/")[-1][:-5], []).append(r)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for stem, document in documents.items():
        want = document.get("data") or []
        rows = sorted(found[stem], key=lambda r: -1 if r.story_index is None else r.story_index)
        assert [r.story_index for r in rows] == (list(range(len(want))) or [None])
        assert not want or [json.loads(r.text) for r in rows] == want
        assert {r.has_data for r in rows} == {"data" in document}
        assert {r.dataset_name for r in rows} == {stem if document.get("name") is None else str(document["name"])}


def test_cut_off_documents_raise(spark, tmp_path):
    for name, text in (("a", '{"data":[{"a":1}'), ("b", '{"data":[{"a":"x}')):
        (tmp_path / f"{name}.json").write_text(text)
        with pytest.raises((PySparkException, Py4JJavaError)):
            read_documents(spark, str(tmp_path / f"{name}.json")).collect()


def test_long_story_comes_back_as_one_document(spark, tmp_path):
    questions = [{"q_id": i, "q_type": "CO", "question": f"q{i}}}", "candidate_answers": [], "answer": [i % 4]} for i in range(25_000)]
    document = {"name": "long", "data": [{"story": "s", "questions": []}, {"extra": {"a": 1}, "questions": questions, "story": "t"}, {"story": "no list"}, {"questions": questions[:3]}]}
    (tmp_path / "long.json").write_text(json.dumps(document))
    stories = read_documents(spark, str(tmp_path / "long.json"))
    with_lists = stories.filter("story_index <> 2")
    none = with_lists.selectExpr("source_file", "story_index", "0L as question_index", "item as prediction").limit(0)
    records = export_predictions(with_lists, none, mode="overlay").select("source_file", "dataset_name", "story_index", "first_question", "item")
    assert records.filter("story_index = 1").count() == 3
    plain = stories.filter("story_index = 2").selectExpr("source_file", "dataset_name", "story_index", "0L as first_question", "item")
    for target, how in (("whole", {"whole": True}), ("parts", {"partitions": 3})):
        write_documents(records.unionByName(plain), str(tmp_path / target), **how)
        text = "".join(p.read_text() for p in sorted((tmp_path / target / "document=long").glob("part-*")))
        assert json.loads(text) == document
    again = flatten(read_documents(spark, str(tmp_path / "whole/*/*")).filter("story_index = 1"))
    assert {r.key for r in again.select("key").collect()} == {f"1:{i}" for i in range(25_000)}
