"""Nested files: reading, flattening, faults, export and round trips."""

import copy
import glob
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from answerframe.functions.answers import candidate_texts
from answerframe.functions.text import normalize_story, strip
from answerframe.operators.export import export_predictions
from answerframe.operators.split import story_split
from answerframe.plans.encoder_run import encoder_inputs, overlay, training_inputs
from answerframe.sources.fingerprint import dataset_fingerprint, fingerprint
from answerframe.sources.questions import labelled, read_documents, read_questions, read_stories
from answerframe.sources.sinks import write_documents, write_report, write_stories


@pytest.fixture
def store(tmp_path):
    def save(name, value):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(value, ensure_ascii=False, indent=1), encoding="utf-8")
        return str(path)

    return save


def test_flatten_keeps_ordinals_types_and_files(spark, sample, store):
    second = {"data": [{"story": "Tiếng Việt", "questions": []}, copy.deepcopy(sample["data"][1])]}
    a, b = store("one/a.json", sample), store("two/b.json", second)
    rows = read_questions(spark, [a, b]).withColumn("answer", F.to_json("answer")).collect()
    assert {(r.source_file.split("/")[-1], r.key) for r in rows} == {("a.json", "0:0"), ("a.json", "0:1")} | {
        (name, f"1:{i}") for i in range(3) for name in ("a.json", "b.json")
    }
    assert {r.dataset_name for r in rows} == {"harbour", "b"}
    answers = {r.key: r.answer for r in rows}
    assert answers == {"0:0": "[3]", "0:1": "[0,4]", "1:0": '["C","A"]', "1:1": '["No"]', "1:2": '["DK"]'}


def test_null_and_missing_answers_differ(spark, sample, store):
    sample["data"][1]["questions"][1]["answer"] = None
    del sample["data"][0]["questions"][1]["answer"]
    frame = read_questions(spark, store("a.json", sample))
    got = {r.key: (r.has_answer_key, r.answer_is_null) for r in frame.collect()}
    assert got == {"0:0": (True, False), "0:1": (False, False), "1:0": (True, False), "1:1": (True, True), "1:2": (True, False)}
    assert {r.key for r in labelled(frame).collect()} == {"0:0", "1:0", "1:1", "1:2"}
    gold = {r.key: r.gold for r in encoder_inputs(frame).collect()}
    assert gold == {"0:0": ["3"], "0:1": None, "1:0": ["C", "A"], "1:1": [], "1:2": ["DK"]}


def test_faults_raise_or_are_kept_as_rejects(spark, sample, store):
    questions = sample["data"][0]["questions"]
    questions[0]["q_type"] = "XX"
    questions[1]["answer"] = ["7"]
    del sample["data"][1]["questions"][0]["candidate_answers"]
    sample["data"].append({"story": "no questions key"})
    sample["data"].append({"questions": [{"q_type": "YN", "question": "?", "candidate_answers": []}]})
    path = store("a.json", sample)
    with pytest.raises(PySparkException):
        read_questions(spark, path).collect()
    with pytest.raises(PySparkException):
        read_questions(spark, path).count()
    got = {(r.story_index, r.question_index): r.reject_reason for r in read_questions(spark, path, on_error="reject").collect()}
    assert got == {
        (0, 0): "unsupported_task", (0, 1): "invalid_gold:invalid_label", (1, 0): "missing_field:candidate_answers", (1, 1): None, (1, 2): None,
        (3, None): "missing_field:questions", (4, 0): "missing_field:story",
    }
    lenient = read_questions(spark, path, lenient=True, on_error="reject").collect()
    assert {(r.story_index, r.question_index): r.reject_reason for r in lenient} == {
        (0, 0): "unsupported_task", (0, 1): None, (1, 0): None, (1, 1): None, (1, 2): None, (4, 0): None,
    }


def test_missing_data_and_broken_json(spark, store, tmp_path):
    path = store("a.json", {"name": "n"})
    assert read_questions(spark, path, lenient=True).count() == 0
    with pytest.raises(PySparkException):
        read_questions(spark, path).collect()
    bad = tmp_path / "bad.json"
    bad.write_text('{"data": [')
    with pytest.raises(Exception, match="does not end with its object"):
        read_questions(spark, str(bad)).collect()


def test_story_and_input_text(spark, sample, store):
    sample["data"][1]["story"] = ["  Có một khối ", "", " 　", "tên là A. "]
    sample["data"].append({"story": "\x1c một chuỗi \n", "questions": [{"q_type": "CO", "question": "Hỏi?", "candidate_answers": ["a", "b"], "answer": 1}]})
    rows = {r.key: r for r in encoder_inputs(read_questions(spark, store("a.json", sample), lenient=True)).collect()}
    assert rows["1:1"].text == "Câu chuyện: Có một khối tên là A.\nCâu hỏi: Is dock B full?"
    assert rows["0:1"].text.endswith("\nCác lựa chọn: 0 | 1 | 2 | 3 | 4 | 5 | 6 | 7")
    assert rows["3:0"].text == "Câu chuyện: một chuỗi\nCâu hỏi: Hỏi?\nCác lựa chọn: a | b"
    assert rows["3:0"].candidates == ["a", "b"] and rows["3:0"].gold == ["1"] and rows["3:0"].labels.co_label == 1


def test_candidate_texts(spark):
    frame = spark.createDataFrame([('["a","true",true,null,3]',)], "t string").select(
        candidate_texts(F.try_variant_get(F.parse_json("t"), "$", "array<variant>")).alias("c")
    )
    assert frame.first().c == ["a", "true", "True", "None", "3"]


@pytest.mark.parametrize("text", ["", " a ", " a ", "\x1fa b\x85", "a​"])
def test_strip_is_python_strip(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(strip(F.col("t")).alias("s")).first().s == text.strip()


def test_missing_story_is_empty(spark):
    frame = spark.createDataFrame([(None,), ("[]",), ('" x "',)], "t string").select(normalize_story(F.parse_json("t")).alias("s"))
    assert [r.s for r in frame.collect()] == ["", "", "x"]


def test_training_needs_answers(spark, sample, store):
    for question in (q for story in sample["data"] for q in story["questions"]):
        del question["answer"]
    with pytest.raises(ValueError):
        training_inputs(read_questions(spark, store("a.json", sample)))


def _predictions(spark, source_file, rows):
    frame = spark.createDataFrame([(source_file, s, q, json.dumps(a)) for s, q, a in rows], "source_file string, story_index long, question_index long, a string")
    return frame.withColumn("prediction", F.parse_json("a")).drop("a")


def _read_back(folder):
    out = {}
    for path in glob.glob(f"{folder}/document=*"):
        text = "\n".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{path}/part-*")))
        out[path.split("document=")[1]] = json.loads(text)
    return out


def test_fresh_export_strips_gold_and_keeps_the_rest(spark, sample, store, tmp_path):
    sample["data"][2]["note"] = {"kept": [1, "x", None]}
    sample["data"].append({"story": ["no", "questions"], "questions": []})
    sample["data"].append({"story": "later", "questions": [{"q_type": "CO", "question": "?", "candidate_answers": [], "answer": [1]}]})
    path = store("harbour.json", sample)
    before = json.loads(open(path, encoding="utf-8").read())
    stories = read_documents(spark, path)
    source = stories.first().source_file
    predictions = _predictions(spark, source, [(1, 2, ["Yes"]), (0, 1, [2]), (1, 0, [])])
    for partitions in (1, 3):
        target = str(tmp_path / f"out{partitions}")
        write_documents(export_predictions(stories, predictions, mode="fresh"), target, partitions=partitions)
        got = _read_back(target)["harbour"]
        wanted = copy.deepcopy(before)
        for item in wanted["data"]:
            for question in item["questions"]:
                question.pop("answer", None)
        for story, i, answer in ((1, 2, ["Yes"]), (0, 1, [2]), (1, 0, [])):
            wanted["data"][story]["questions"][i]["answer"] = answer
        assert got == wanted
    assert json.loads(open(path, encoding="utf-8").read()) == before


def test_overlay_export_keeps_given_answers(spark, sample, store, tmp_path):
    path = store("harbour.json", sample)
    stories = read_documents(spark, path)
    predicted = spark.createDataFrame(
        [(stories.first().source_file, 0, 1, "FR", ["2", "5"])],
        "source_file string, story_index long, question_index long, q_type string, prediction array<string>",
    )
    write_documents(overlay(stories, predicted), str(tmp_path / "out"), partitions=1)
    wanted = copy.deepcopy(sample)
    wanted["data"][0]["questions"][1]["answer"] = [2, 5]
    assert _read_back(str(tmp_path / "out"))["harbour"] == wanted


def test_long_story_is_split_into_records_and_reads_back_whole(spark, store, tmp_path):
    questions = [{"q_id": i, "q_type": "CO", "question": f"q{i}", "candidate_answers": [], "answer": [i % 4]} for i in range(57)]
    path = store("long.json", {"name": "long", "data": [{"story": "s", "extra": 1, "questions": questions}, {"story": "t", "questions": []}]})
    stories = read_documents(spark, path)
    empty = _predictions(spark, "none", [(0, 0, [1])])
    records = export_predictions(stories, empty, mode="overlay", per_record=10)
    assert records.filter("story_index = 0").count() == 6 and records.filter("story_index = 1").count() == 1
    write_stories(records, str(tmp_path / "stories"))
    again = read_stories(spark, str(tmp_path / "stories"))
    assert again.filter(F.try_variant_get("item", "$.extra", "int") == 1).count() == 6
    back = read_questions(spark, str(tmp_path / "stories"), layout="stories")
    columns = ["source_file", "dataset_name", "key", "q_type", "question", F.to_json("answer").alias("answer")]
    first, second = read_questions(spark, path).select(*columns), back.select(*columns)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))
    # Exporting the split records again gives the same records.
    twice = export_predictions(again, empty, mode="overlay", per_record=10)
    as_text = ["story_index", "first_question", F.to_json("item").alias("item")]
    assert sorted(map(tuple, twice.select(*as_text).collect())) == sorted(map(tuple, records.select(*as_text).collect()))


def test_story_split_never_divides_a_story(spark, sample, store):
    sample["data"] = [copy.deepcopy(sample["data"][0]) for _ in range(60)]
    split = story_split(read_questions(spark, store("a.json", sample)), eval_ratio=0.3)
    sides = split.groupBy("story_index").agg(F.count_distinct("is_eval").alias("n"))
    assert sides.filter("n > 1").count() == 0
    assert 5 <= split.filter("is_eval").select("story_index").distinct().count() <= 32


def test_fingerprints(spark, store):
    import hashlib

    paths = [store(f"{i}.json", {"data": [], "i": i}) for i in range(3)]
    got = {r.source_file.split("/")[-1]: r.sha256 for r in fingerprint(spark, paths).collect()}
    assert got == {f"{i}.json": hashlib.sha256(open(p, "rb").read()).hexdigest() for i, p in enumerate(paths)}
    one = dataset_fingerprint(fingerprint(spark, paths)).first()
    other = dataset_fingerprint(fingerprint(spark, paths[::-1])).first()
    fewer = dataset_fingerprint(fingerprint(spark, paths[:2])).first()
    assert one == other and one.files == 3 and one.input_sha256 != fewer.input_sha256


def test_large_files_are_hashed_split_by_split(spark, tmp_path):
    import hashlib
    import os

    from answerframe.sources import fingerprint as module

    block = os.urandom(module.PIECE)
    names = {"a[1], {b} c.bin": (75 << 20) + 17, "even.bin": 64 << 20, "d.gz": 3000, "small": 5}
    for name, size in names.items():
        with open(tmp_path / name, "wb") as file:
            for i in range(0, size, len(block)):
                file.write((i.to_bytes(8, "big") + block)[: min(len(block), size - i)])
    # Spark passes on no more than a split of a larger file at once, so this bound would have failed on the whole.
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 60 << 20)
    try:
        got = {r.source_file.split("/")[-1]: (r.bytes, r.sha256) for r in fingerprint(spark, str(tmp_path), whole=2000).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {n: (size, hashlib.sha256((tmp_path / n).read_bytes()).hexdigest()) for n, size in names.items()}
    assert dataset_fingerprint(fingerprint(spark, str(tmp_path), whole=2000)).first() == dataset_fingerprint(fingerprint(spark, str(tmp_path))).first()


def test_report_is_one_file_and_is_replaced(spark, tmp_path):
    for value in ("Tiếng Việt", "again"):
        write_report(spark.createDataFrame([(value,)], "v string"), str(tmp_path / "deep/er/report"))
        parts = glob.glob(str(tmp_path / "deep/er/report/part-*"))
        assert len(parts) == 1 and json.loads(open(parts[0], encoding="utf-8").read()) == {"v": value}
