"""The attempt log, resumed runs, streams, splits, positions and models."""

import json
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from answerframe.functions.labels import encode_labels
from answerframe.operators.attempts import (
    attach_predictions,
    attempt_summary,
    config_drift,
    latest_success,
    pending,
    successes_of,
    usage_totals,
)
from answerframe.operators.audit import leak_audit, truncation_audit
from answerframe.operators.infer import apply_heads, fit_heads, score_with_model
from answerframe.operators.select import prefix, with_position
from answerframe.operators.split import split_overlap, stratified_split
from answerframe.plans.encoder_run import evaluate, predict
from answerframe.plans.remote_run import RunConfig, ask, finish
from answerframe.sources.attempts import append_attempts, read_attempts
from answerframe.sources.questions import read_questions
from answerframe.streaming.log import compact_latest, publish, read_latest, read_published, run_latest, run_tally, stream_attempts


def _call(answers, log):
    def call(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for key in frame["key"]:
            with open(log, "a") as out:
                out.write(key + "\n")
            rows.append(json.dumps({"reasoning": "It says so.", "answer": answers[key]}))
        n = len(frame)
        return pd.DataFrame(
            {
                "source_file": frame["source_file"], "key": frame["key"], "response_id": ["r"] * n, "response_model": ["m"] * n,
                "usage": [{"prompt_tokens": 7, "completion_tokens": 2, "total_tokens": 9}] * n,
                "finish_reason": ["stop"] * n, "refusal": [None] * n, "content": rows,
            }
        )

    return call


RIGHT = {"0:0": [3], "0:1": [0, 4], "1:0": ["C", "A"], "1:1": ["No"], "1:2": ["DK"]}


def test_later_runs_ask_only_what_is_open(spark, sample, tmp_path):
    path, run, calls = str(tmp_path / "data.json"), str(tmp_path / "run"), tmp_path / "calls"
    with open(path, "w") as out:
        json.dump(sample, out)
    calls.touch()
    config = RunConfig("https://models.example/", "first-model", "p", "0" * 64)
    questions = read_questions(spark, path)
    given = {**RIGHT, "0:1": [4]}
    for chosen, asked in (("story_index = 1", 3), ("q_type in ('YN', 'FR')", 4), ("true", 5), ("true", 5)):
        ask(questions.filter(chosen), config, run, _call(given, str(calls)))
        assert len(calls.read_text().split()) == asked
    assert set(calls.read_text().split()) == set(RIGHT)
    with pytest.raises(ValueError, match="model"):
        ask(questions, RunConfig("https://models.example/", "second-model", "p", "0" * 64), run, _call(given, str(calls)))
    report = finish(spark, path, run).first()
    assert report.status == "complete" and report.usage_all_attempts.total_tokens == 5 * 9
    assert (report.by_task["FR"].exact_match, report.by_task["FR"].jaccard, report.by_task["YN"].accuracy) == (0.0, 0.5, 1.0)
    back = read_questions(spark, f"{run}/predictions", layout="stories")
    assert {r.key: json.loads(r.a) for r in back.select("key", F.to_json("answer").alias("a")).collect()} == given


def test_log_without_settings_is_refused(spark, sample, tmp_path):
    path, run = str(tmp_path / "data.json"), tmp_path / "run"
    with open(path, "w") as out:
        json.dump(sample, out)
    (run / "responses").mkdir(parents=True)
    (run / "responses" / "old.json").write_text('{"key":"0:0","error":"E"}\n')
    with pytest.raises(ValueError, match="no settings"):
        ask(read_questions(spark, path), RunConfig("u", "m", "p", "0" * 64), str(run), _call({}, str(tmp_path / "calls")))


def test_failed_attempts_are_asked_again(spark, sample, tmp_path):
    path, run, calls = str(tmp_path / "data.json"), str(tmp_path / "run"), str(tmp_path / "calls")
    with open(path, "w") as out:
        json.dump(sample, out)
    open(calls, "w").close()
    config = RunConfig("https://models.example/", "m", "p", "0" * 64)
    questions = read_questions(spark, path)
    ask(questions, config, run, _call({**RIGHT, "1:1": ["maybe"]}, calls))
    report = finish(spark, path, run).first()
    assert (report.status, report.coverage) == ("partial", 0.8)
    ask(questions, config, run, _call({"1:1": ["Yes"]}, calls))
    assert Counter(open(calls).read().split())["1:1"] == 2
    report = finish(spark, path, run).first()
    assert report.status == "complete" and report.by_task["YN"].accuracy == 0.5 and report.usage_all_attempts.total_tokens == 6 * 9


def _log(spark, rows):
    schema = "source_file string, key string, position long, a string, error string, total long"
    return spark.createDataFrame(rows, schema).select(
        "source_file", "key", "position", F.parse_json("a").alias("answer"), "error",
        F.when(F.col("total").isNotNull(), F.struct(F.lit(None).cast("long").alias("prompt_tokens"), F.lit(None).cast("long").alias("completion_tokens"), F.col("total").alias("total_tokens"))).alias("usage"),
    )


def test_log_views(spark):
    log = _log(spark, [("f", "1", 1, '["Yes"]', None, 5), ("f", "1", 3, '["No"]', None, 5), ("f", "1", 4, None, "APIError", None),
                       ("f", "2", 2, None, "InvalidResponse", 7), ("g", "1", 9, '["DK"]', None, 1)])
    got = {(r.source_file, r.key): r.a for r in latest_success(log).select("source_file", "key", F.to_json("answer").alias("a")).collect()}
    assert got == {("f", "1"): '["No"]', ("g", "1"): '["DK"]'}
    questions = spark.createDataFrame([("f", "1"), ("f", "2"), ("f", "3")], "source_file string, key string")
    assert {r.key for r in pending(questions, log).collect()} == {"2", "3"}
    joined = attach_predictions(questions, log).select("key", F.to_json("prediction").alias("p")).collect()
    assert {r.key: r.p for r in joined} == {"1": '["No"]', "2": None, "3": None}
    assert successes_of(log, questions).count() == 2
    assert usage_totals(log).first().asDict() == {"prompt_tokens": 0, "completion_tokens": 0, "total_tokens": 18}
    assert {r.outcome: r.attempts for r in attempt_summary(log).collect()} == {"OK": 3, "APIError": 1, "InvalidResponse": 1}


def test_reading_logs(spark, tmp_path):
    assert read_attempts(spark, str(tmp_path / "absent")).count() == 0
    log = tmp_path / "log.jsonl"
    log.write_text('{"key":"0:0","answer":[]}\n\n   \n{"key":"0:1","error":"E","usage":null}\n')
    rows = read_attempts(spark, str(log)).orderBy("position").collect()
    assert [r.key for r in rows] == ["0:0", "0:1"] and rows[0].answer is not None and rows[1].answer is None
    log.write_text('{"key":"0:0"}\n{"key":\n')
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        read_attempts(spark, str(log)).collect()


def test_config_drift(spark):
    a = spark.createDataFrame([("r", 0.0, None), ("s", 0.0, "p")], "run string, temperature double, prompt string")
    b = spark.createDataFrame([("r", 0.2, None), ("s", 0.0, None)], "run string, temperature double, prompt string")
    assert {(r.run, r.field) for r in config_drift(a, b, on=["run"]).collect()} == {("r", "temperature"), ("s", "prompt")}
    assert config_drift(a, a, on=["run"]).count() == 0


def test_streams_follow_a_growing_log(spark, tmp_path):
    log, table, marks = str(tmp_path / "log"), str(tmp_path / "t"), str(tmp_path / "c")
    tally, tally_marks = str(tmp_path / "tally"), str(tmp_path / "tc")

    def add(name, rows):
        (tmp_path / "log").mkdir(exist_ok=True)
        (tmp_path / "log" / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")

    add("1.json", [{"source_file": "f", "key": "a", "seq": 1, "answer": ["Yes"], "usage": {"total_tokens": 3}},
                   {"source_file": "f", "key": "b", "seq": 2, "error": "E"}])
    for _ in range(2):
        run_latest(stream_attempts(spark, log), table, marks, position="seq")
        run_tally(stream_attempts(spark, log), tally, tally_marks)
    add("2.json", [{"source_file": "f", "key": "a", "seq": 3, "answer": ["No"]}, {"source_file": "f", "key": "b", "seq": 4, "answer": []}])
    run_latest(stream_attempts(spark, log), table, marks, position="seq")
    run_tally(stream_attempts(spark, log), tally, tally_marks)
    compact_latest(spark, table, str(tmp_path / "compact"), position="seq")
    for place in (table, str(tmp_path / "compact")):
        got = {r.key: r.a for r in read_latest(spark, place, position="seq").select("key", F.to_json("answer").alias("a")).collect()}
        assert got == {"a": '["No"]', "b": "[]"}
    got = {r.outcome: (r.attempts, r.total_tokens) for r in read_published(spark, tally).collect()}
    assert got == {"OK": (3, 3), "E": (1, 0)}


def _many(spark, n, hot=None):
    """Questions of one file; with ``hot`` a third of them belong to one story."""
    story = F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.col("id") % 97) if hot is not None else F.col("id") % 97
    return spark.range(n).select(
        F.lit("f").alias("source_file"), F.lit("d").alias("dataset_name"), story.alias("story_index"), F.col("id").alias("question_index"),
        F.concat_ws(":", story, "id").alias("key"),
        F.expr("case when id < 3 then 'CO' when id % 5 = 0 then 'YN' when id % 5 = 1 then 'FR' else 'FB' end").alias("q_type"),
    )


@pytest.mark.parametrize("ratio", [0.0, 0.2, 0.5, 0.99])
def test_stratified_split_has_exact_sizes(spark, ratio):
    questions = _many(spark, 2003)
    split = stratified_split(questions, eval_ratio=ratio, seed=7)
    sizes = {r.q_type: (r.n, r.e) for r in split.groupBy("q_type").agg(F.count("*").alias("n"), F.count_if("is_eval").alias("e")).collect()}
    assert all(e == max(1, round(n * ratio)) for n, e in sizes.values()) and sum(n for n, _ in sizes.values()) == 2003
    chosen = {r.key for r in split.filter("is_eval").collect()}
    again = stratified_split(questions.repartition(11), eval_ratio=ratio, seed=7)
    assert {r.key for r in again.filter("is_eval").collect()} == chosen
    other = stratified_split(questions, eval_ratio=0.5, seed=8)
    assert {r.key for r in other.filter("is_eval").collect()} != chosen


def test_single_question_of_a_task_stays_in_training(spark):
    one = _many(spark, 1)
    assert stratified_split(one, eval_ratio=0.9).filter("is_eval").count() == 0


def test_split_overlap_finds_divided_stories(spark):
    rows = [("d", 1, True), ("d", 1, False), ("d", 2, True), ("e", 1, False)]
    got = split_overlap(spark.createDataFrame(rows, "dataset_name string, story_index int, is_eval boolean")).collect()
    assert [(r.dataset_name, r.story_index, r.train_questions, r.eval_questions) for r in got] == [("d", 1, 1, 1)]


def test_positions_with_a_hot_story(spark):
    questions = _many(spark, 3000, hot=41)
    rows = with_position(questions).collect()
    ordered = sorted(rows, key=lambda r: (r.source_file, r.story_index, r.question_index))
    assert [r.position for r in ordered] == list(range(1, 3001)) and {r.selected for r in rows} == {3000}


def test_prefix_is_the_first_by_position(spark):
    rows = [(f, f"{i:03d}", i) for f in ("b", "a") for i in range(100)]
    questions = spark.createDataFrame(rows, "source_file string, key string, selected int").selectExpr(
        "source_file", "key", "cast(selected as bigint) as story_index", "0L as question_index", "selected"
    ).repartition(5)
    for n in (1, 120, 500):
        got = prefix(questions, n)
        assert "selected" in got.columns
        assert sorted((r.source_file, r.key) for r in got.collect()) == sorted((f, k) for f, k, _ in rows)[:n]
    with pytest.raises(ValueError):
        prefix(questions, 0)


def test_audits(spark):
    frame = spark.createDataFrame([('{"story":1,"question":2,"q_type":3,"candidate_answers":4}',), ('{"story":1,"answer":2}',)], "payload_json string")
    assert [(r.field, r.requests) for r in leak_audit(frame).collect()] == [("answer", 1)]
    texts = spark.createDataFrame([("YN", "a b c d", "a b"), ("YN", "a b", "a")], "q_type string, text string, before_question string")
    row = truncation_audit(texts, max_length=4).first()
    assert (row.questions, row.truncated, row.question_lost, row.longest) == (2, 1, 1, 4)


def test_model_scoring_and_evaluation(spark):
    rows = [(f"k{i}", ["YN", "FR", "FB", "CO"][i % 4], [float(i % 3), 1.0]) for i in range(20)]
    frame = spark.createDataFrame(rows, "key string, q_type string, features array<float>")

    def make():
        import numpy as np

        def run(x):
            first = x[:, :1]
            return {"yn": np.hstack([first == j for j in range(3)]).astype("float32"), "co": np.zeros((len(x), 4), "float32"),
                    "fr": np.hstack([first - 1] * 8), "fb": np.hstack([first - 1] * 3)}

        return run

    scored = predict(score_with_model(frame, make, "features", width=2).withColumn("candidates", F.array().cast("array<string>")))
    got = {r.key: r.prediction for r in scored.collect()}
    assert got["k4"] == ["No"] and got["k8"] == ["DK"] and got["k3"] == ["0"] and got["k6"] == [] and got["k1"] == list("01234567")
    pooled, files, primary = evaluate(scored.withColumn("gold", F.col("prediction")).withColumn("source_file", F.lit("f")))
    assert primary.first().primary_score == 1.0 and files.count() == 1 and pooled.count() == 4


def test_heads_learn_separable_labels(spark):
    rows = []
    for i in range(240):
        a, b = i % 2, (i // 2) % 2
        x = [2.0 * a - 1, 2.0 * b - 1]
        task = ["YN", "CO", "FR", "FB"][i // 4 % 4]
        gold = {"YN": [["Yes", "No"][a]], "CO": [str(2 * a + b)], "FR": [str(v) for v, on in ((2, a), (5, b)) if on] or ["7"],
                "FB": [v for v, on in (("A", a), ("B", b)) if on]}[task]
        rows.append((str(i), task, x, gold, ["A", "B"] if task == "FB" else []))
    frame = spark.createDataFrame(rows, "key string, q_type string, features array<double>, gold array<string>, candidates array<string>")
    frame = frame.withColumn("labels", encode_labels(F.col("q_type"), F.col("gold"), F.col("candidates")))
    models = fit_heads(frame, reg=0.001, parallelism=3)
    assert models["fb2"] is None
    wrong = predict(apply_heads(frame, models)).filter(F.array_sort("prediction") != F.array_sort("gold"))
    assert wrong.count() == 0


def test_a_run_over_story_lines(spark, tmp_path):
    path, run = tmp_path / "in", str(tmp_path / "run")
    path.mkdir()
    story = {"story": "Two kites.", "questions": [{"q_type": "YN", "question": "One?", "candidate_answers": [], "answer": ["No"]}]}
    (path / "part.json").write_text(json.dumps({"source_file": "kites.json", "dataset_name": "kites", "story_index": 0, "first_question": 0, "item": story}) + "\n")
    questions = read_questions(spark, str(path), layout="stories")
    ask(questions, RunConfig("https://models.example/", "m", "p", "0" * 64), run, _call({"0:0": ["No"]}, str(tmp_path / "calls")))
    report = finish(spark, str(path), run, layout="stories", evaluation="trial").first()
    assert (report.status, report.evaluation, report.by_task["YN"].accuracy) == ("complete", "trial", 1.0)


def _failing(answers, log, bad):
    class Broken(Exception):
        """What a client raises, with a status and a body."""

        status_code = 400
        body = {"error": {"message": "no such option: hush-hush sk-abc Bearer xyz", "code": "odd", "param": "p", "headers": {"a": 1}}}

    answered = _call(answers, log)

    def call(frame):
        if frame["key"].iloc[0] in bad:
            raise Broken("client failed")
        return answered(frame)

    return call


def test_failed_call_is_logged_cleaned_and_keeps_replies(spark, sample, tmp_path):
    path, run, calls = str(tmp_path / "data.json"), str(tmp_path / "run"), str(tmp_path / "calls")
    with open(path, "w") as out:
        json.dump(sample, out)
    open(calls, "w").close()
    config = RunConfig("https://models.example/", "m", "p")
    questions = read_questions(spark, path).coalesce(1).sortWithinPartitions("key")
    assert not ask(questions, config, run, _failing(RIGHT, calls, {"1:0"}), inputs=path, secrets=["hush-hush"], per_call=1)
    log = {r.key: r for r in read_attempts(spark, f"{run}/responses").withColumn("answer", F.to_json("answer")).collect()}
    # The two before it are kept, and nothing was asked after it.
    assert set(log) == {"0:0", "0:1", "1:0"} and log["0:0"].answer and log["0:1"].answer and log["1:0"].answer is None
    details = log["1:0"].error_details
    assert (log["1:0"].error, details.status_code, details.code, details.param) == ("Broken", 400, "odd", "p")
    assert not any(secret in details.message for secret in ("hush-hush", "sk-abc", "xyz")) and "no such option" in details.message
    assert finish(spark, path, run).first().status == "partial"
    assert ask(questions, config, run, _failing(RIGHT, calls, set()), inputs=path)
    assert Counter(open(calls).read().split()) == dict.fromkeys(RIGHT, 1)
    report = finish(spark, path, run).first()
    assert report.status == "complete" and report.usage_all_attempts.total_tokens == 5 * 9


def test_no_wave_begins_after_a_failure(spark, sample, tmp_path):
    path, run, calls = str(tmp_path / "data.json"), str(tmp_path / "run"), str(tmp_path / "calls")
    with open(path, "w") as out:
        json.dump(sample, out)
    open(calls, "w").close()
    config, questions = RunConfig("https://models.example/", "m", "p"), read_questions(spark, path)
    assert not ask(questions, config, run, _failing(RIGHT, calls, set(RIGHT)), wave=1)
    failed = read_attempts(spark, f"{run}/responses").count()
    assert failed < len(RIGHT) and not open(calls).read()
    assert ask(questions, config, run, _call(RIGHT, calls), wave=2)
    assert Counter(open(calls).read().split()) == dict.fromkeys(RIGHT, 1)


def test_empty_selection_and_changed_input_are_refused(spark, sample, tmp_path):
    path, run, calls = str(tmp_path / "data.json"), str(tmp_path / "run"), str(tmp_path / "calls")
    with open(path, "w") as out:
        json.dump(sample, out)
    config, questions = RunConfig("https://models.example/", "m", "p"), read_questions(spark, path)
    with pytest.raises(ValueError, match="no questions"):
        ask(questions.limit(0), config, run, _call(RIGHT, calls), inputs=path)
    ask(questions, config, run, _call(RIGHT, calls), inputs=path)
    with open(path, "a") as out:
        out.write("\n")
    with pytest.raises(ValueError, match="input_sha256"):
        ask(questions, config, run, _call(RIGHT, calls), inputs=path)


def test_unknown_tasks_are_refused_by_the_split(spark):
    rows = spark.createDataFrame([("f", "0:0", "YN"), ("f", "0:1", "XX")], "source_file string, key string, q_type string")
    with pytest.raises(Exception, match="unsupported task: XX"):
        stratified_split(rows).collect()


@pytest.mark.parametrize("bits", [3, 14])
def test_split_takes_the_smallest_hashes(spark, monkeypatch, bits):
    import hashlib

    from answerframe.operators import split

    monkeypatch.setattr(split, "_LEVEL_BITS", bits)
    questions = _many(spark, 700)
    rows = stratified_split(questions, eval_ratio=0.31, seed=5).select("q_type", "source_file", "key", "is_eval").collect()
    for task in ("YN", "FR", "FB", "CO"):
        own = sorted((hashlib.md5(f"5:{r.source_file}:{r.key}".encode()).hexdigest(), r.is_eval) for r in rows if r.q_type == task)
        taken = max(1, round(len(own) * 0.31))
        assert [e for _, e in own] == [True] * taken + [False] * (len(own) - taken)


def test_split_with_equal_keys_ends(spark):
    rows = spark.createDataFrame([("f", "same", "YN")] * 6 + [("f", "other", "YN")] * 2, "source_file string, key string, q_type string")
    sides = {(r.key, r.is_eval) for r in stratified_split(rows, eval_ratio=0.1).collect()}
    assert len(sides) == 2


def test_readers_keep_what_they_began_with_and_reruns_replace(spark, tmp_path):
    table = str(tmp_path / "table")
    publish(spark.range(3), table, 0)
    early = read_published(spark, table)
    publish(spark.range(5), table, 1)
    # A version is written, and its writer lost before the pointer: nobody sees it.
    spark.range(99).write.parquet(f"{table}/rows-2-lost")
    assert (early.count(), read_published(spark, table).count()) == (3, 5)
    publish(spark.range(7), table, 1)
    assert read_published(spark, table).count() == 7


def test_latest_without_numbers_over_restarts(spark, tmp_path):
    log, table, marks = (str(tmp_path / name) for name in ("log", "table", "marks"))
    schema = "source_file string, key string, a string, error string"
    sessions = [[("f", "a", '["Yes"]', None), ("f", "a", '["No"]', None), ("f", "b", None, "E")], [("f", "b", "[]", None), ("f", "a", None, "E")], [("f", "b", "[1]", None), ("f", "c", "[2]", None)]]
    for rows in sessions:
        frame = spark.createDataFrame(rows, schema).coalesce(1)
        append_attempts(frame.select("source_file", "key", F.parse_json("a").alias("answer"), "error"), log)
        for _ in range(2):
            run_latest(stream_attempts(spark, log), table, marks)
    got = {r.key: r.a for r in read_latest(spark, table).select("key", F.to_json("answer").alias("a")).collect()}
    assert got == {"a": '["No"]', "b": "[1]", "c": "[2]"}
