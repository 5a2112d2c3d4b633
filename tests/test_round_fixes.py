"""Cases that once went wrong: absent paths, one-sided manifests, tails after a value, long scenes."""

from pyspark.sql import functions as F

from answerframe.operators.attempts import config_drift
from answerframe.operators.replies import with_strict_json
from answerframe.operators.select import prefix
from answerframe.sources.attempts import read_attempts
from answerframe.sources.bridge import scene_relations_from_lineitem


def test_manifest_on_one_side_only(spark):
    a = spark.createDataFrame([("r", "m")], "run string, model string")
    b = spark.createDataFrame([("s", "m")], "run string, model string")
    assert {(r.run, r.field) for r in config_drift(a, b, on=["run"]).collect()} == {("r", "missing_manifest"), ("s", "missing_manifest")}
    assert [r.field for r in config_drift(a, b.limit(0)).collect()] == ["missing_manifest"]


def test_an_absent_path_empties_no_other(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"key": "0:0", "source_file": "f"}\n')
    assert read_attempts(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "absent")]).count() == 1
    assert read_attempts(spark, str(tmp_path / "absent")).count() == 0


def test_tails_after_a_value_are_rejected(spark):
    good = '{"reasoning": "x", "answer": ["Yes"]}'
    tails = ["", " x", "] and more", "],[1", "} x", ',"v":1', "}]"]
    rows = spark.createDataFrame([(i, good + t) for i, t in enumerate(tails)], "i int, content string")
    got = {r.i: r.ok for r in with_strict_json(rows, "content", "v").select("i", F.col("v").isNotNull().alias("ok")).collect()}
    assert got == {i: i == 0 for i in range(len(tails))}


def test_prefix_keeps_a_column_named_selected(spark):
    rows = spark.createDataFrame([(i, -i) for i in range(50)], "selected int, story_index int")
    assert sorted(r.selected for r in prefix(rows, 3, ["story_index"]).collect()) == [47, 48, 49]


def test_line_numbers_over_31(spark, tmp_path):
    lines = spark.createDataFrame([(1, n) for n in (1, 35, 36, 35)], "l_orderkey long, l_linenumber int")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    assert {(r.subj, r.obj) for r in scene_relations_from_lineitem(spark, str(tmp_path)).collect()} == {("L1", "L35"), ("L35", "L36")}
