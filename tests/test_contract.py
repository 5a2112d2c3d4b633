"""Answers: validation, normalisation, replies, redaction and requests."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from answerframe.functions.answers import check_answers, labels_json, normalize_answer, validate_labels
from answerframe.functions.redact import redact
from answerframe.operators.attempts import clean_errors
from answerframe.operators.replies import parse_replies
from answerframe.plans.remote_run import RunConfig, build_requests
from answerframe.sources.questions import read_questions

# What each task allows: its labels (FB: the candidates) and how many of them.
ALLOWED = {"YN": (["Yes", "No", "DK"], 1, 1), "CO": ([0, 1, 2, 3], 1, 1), "FR": ([*range(8)], 1, 7), "FB": (["Kiosk", "D", "x y"], 0, 3)}


def _cases():
    """Every subset of up to two labels, its labels in another type or case, and values that are no labels at all."""
    out = []
    for task, (labels, least, most) in ALLOWED.items():
        candidates = labels if task == "FB" else []
        short = "needs_a_relation" if task == "FR" else "needs_one_label"
        out.append((task, candidates, "[]", short if least else None))
        for a in labels:
            other = str(a) if isinstance(a, int) else a.swapcase()
            out += [(task, candidates, json.dumps([a]), None), (task, candidates, json.dumps([other]), "invalid_label")]
            for b in labels:
                if a == b:
                    reason = "duplicate_label"
                elif most == 1:
                    reason = short
                else:
                    reason = "dk_not_alone" if task == "FR" and 7 in (a, b) else None
                out.append((task, candidates, json.dumps([a, b]), reason))
        out += [(task, candidates, text, "not_a_list") for text in ("null", "5", '"No"', '{"0":0}', "true")]
        out += [(task, candidates, f"[{text}]", "invalid_label") for text in ("null", "[]", "{}", "2.0", "-3", "9" * 25, "false")]
    typed = [("FB", [4, "4"], "[4]", "invalid_label"), ("FB", [4, "B"], '["4"]', "invalid_label")]
    return [*out, *typed, ("QQ", [], "[0]", "unsupported_task")]


CASES = _cases()


def _answers(spark, cases):
    rows = [(i, c[0], json.dumps(c[1]), c[2]) for i, c in enumerate(cases)]
    return spark.createDataFrame(rows, "i int, q_type string, c string, a string").select(
        "i",
        "q_type",
        F.try_variant_get(F.parse_json("c"), "$", "array<variant>").alias("candidates"),
        F.parse_json("a").alias("answer"),
    )


def test_answer_validation(spark):
    got = {r.i: r.reason for r in check_answers(_answers(spark, CASES)).select("i", "reason").collect()}
    assert [(c[0], c[2], got[i]) for i, c in enumerate(CASES)] == [(c[0], c[2], c[3]) for c in CASES]


def test_typed_labels_follow_the_same_rules(spark):
    cases = [c for c in CASES if c[3] not in ("not_a_list",) and c[0] in ("YN", "FR", "CO") and "null" not in c[2]]
    typed = [c for c in cases if all(isinstance(v, int if c[0] != "YN" else str) and v is not True for v in json.loads(c[2]))]
    rows = [(i, c[0], [str(v) for v in json.loads(c[2])]) for i, c in enumerate(typed)]
    frame = spark.createDataFrame(rows, "i int, q_type string, labels array<string>").select(
        "i", validate_labels(F.col("labels"), F.col("q_type"), F.array().cast("array<string>")).alias("reason")
    )
    got = {r.i: r.reason for r in frame.collect()}
    assert [got[i] for i in range(len(typed))] == [c[3] for c in typed]


@pytest.mark.parametrize(
    "task,text,wanted",
    [
        ("FR", "null", []), ("FR", "3", ["3"]), ("FR", '["7"]', ["7"]), ("FR", "[true]", ["1"]), ("FR", "[3.9,-3.9]", ["3", "-3"]),
        ("CO", '" 2 "', ["2"]), ("CO", '["1_0"]', ["10"]), ("FR", '[1,"2",false]', ["1", "2", "0"]), ("FR", "[2e0]", ["2"]),
        ("YN", '"Yes"', ["Yes"]), ("YN", '["Yes"]', ["Yes"]), ("FB", "[]", []), ("FB", '["A","B"]', ["A", "B"]),
    ],
)
def test_normalize_answer(spark, task, text, wanted):
    frame = spark.createDataFrame([(task, text)], "q_type string, a string")
    got = frame.select(normalize_answer(F.parse_json("a"), F.col("q_type")).alias("x")).first().x
    assert got == wanted


def test_normalize_answer_keeps_missing_and_refuses_junk(spark):
    frame = spark.createDataFrame([("FR", None)], "q_type string, a string")
    assert frame.select(normalize_answer(F.parse_json("a"), F.col("q_type")).alias("x")).first().x is None
    for junk in ('["x"]', '["3.9"]', "[null]", '[{"a":1}]'):
        bad = spark.createDataFrame([("FR", junk)], "q_type string, a string")
        with pytest.raises(PySparkException):
            bad.select(normalize_answer(F.parse_json("a"), F.col("q_type"))).collect()


def test_labels_json_is_typed(spark):
    frame = spark.createDataFrame([("FR", ["2", "5"]), ("YN", ["Yes"]), ("FB", [])], "q_type string, l array<string>")
    assert [r[0] for r in frame.select(labels_json(F.col("l"), F.col("q_type"))).collect()] == ["[2,5]", '["Yes"]', "[]"]


def _replies(spark, rows):
    schema = "key string, finish_reason string, refusal string, content string, q_type string"
    return spark.createDataFrame(rows, schema).select(
        "*",
        F.lit("f").alias("source_file"),
        F.array().cast("array<variant>").alias("candidates"),
        F.lit("id").alias("response_id"),
        F.lit("m").alias("response_model"),
        F.expr("named_struct('prompt_tokens', 31L, 'completion_tokens', 8L, 'total_tokens', 39L)").alias("usage"),
    )


def test_replies(spark):
    def good(answer):
        return json.dumps({"reasoning": "It says so.", "answer": answer, "more": 1})

    rows = [
        ("ok", "stop", None, good(["Yes"]), "YN"),
        ("empty refusal", "stop", "", good(["Yes"]), "YN"),
        ("length", "length", None, good(["Yes"]), "YN"),
        ("refused", "stop", "no", good(["Yes"]), "YN"),
        ("unfinished", None, None, good(["Yes"]), "YN"),
        ("invalid", "stop", None, good(["perhaps"]), "YN"),
        ("no text", "stop", None, None, "YN"),
        ("junk", "stop", None, good(["Yes"]) + " x", "YN"),
        ("two", "stop", None, good(["Yes"]) + "," + good(["Yes"]), "YN"),
        ("list", "stop", None, "[1]", "YN"),
        ("reasoning", "stop", None, json.dumps({"reasoning": 1, "answer": ["Yes"]}), "YN"),
        ("no reasoning", "stop", None, json.dumps({"answer": ["Yes"]}), "YN"),
        ("no answer", "stop", None, json.dumps({"reasoning": "x"}), "YN"),
        ("null answer", "stop", None, json.dumps({"reasoning": "x", "answer": None}), "YN"),
        ("spaces", "stop", None, "  " + good([2, 5]) + "\n", "FR"),
    ]
    got = {r.key: r for r in parse_replies(_replies(spark, rows)).withColumn("answer", F.to_json("answer")).collect()}
    incomplete, invalid = "RefusedOrIncompleteResponse", "InvalidResponse"
    assert {k: r.error for k, r in got.items()} == {
        "ok": None, "empty refusal": None, "length": incomplete, "refused": incomplete, "unfinished": incomplete,
        "invalid": invalid, "no text": invalid, "junk": invalid, "two": invalid, "list": invalid, "reasoning": invalid,
        "no reasoning": invalid, "no answer": invalid, "null answer": invalid, "spaces": None,
    }
    assert got["ok"].answer == '["Yes"]' and got["ok"].reasoning == "It says so." and got["spaces"].answer == "[2,5]"
    assert all(r.usage.total_tokens == 39 for r in got.values())
    assert all(r.answer is None and r.reasoning is None for r in got.values() if r.error)


def test_errors_keep_parameters_and_lose_secrets(spark):
    body = {
        "error": {
            "message": "Refused parameter top_k: own-secret-17 sk-abc_1-d Bearer qwe.rty",
            "code": "bad_parameter",
            "param": "top_k",
            "type": 1.5,
            "headers": {"Authorization": "private"},
        }
    }
    frame = spark.createDataFrame([(400, json.dumps(body))], "status_code int, b string").select(
        "status_code", F.parse_json("b").alias("body")
    )
    details = clean_errors(frame, secrets=["own-secret-17"]).first().error_details.asDict()
    assert details["status_code"] == 400 and details["param"] == "top_k" and details["type"] is None
    assert details["message"] == "Refused parameter top_k: [REDACTED] [REDACTED] Bearer [REDACTED]"
    assert set(details) == {"status_code", "message", "code", "param", "type"}


def test_error_bodies_of_other_shapes(spark):
    bodies = ['{"message":"m","code":7,"param":true}', '{"error":null,"message":"m"}', '{"error":"text"}', '"text"', None]
    frame = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "status_code int, b string").select(
        "status_code", F.parse_json("b").alias("body")
    )
    got = {r.error_details.status_code: r.error_details for r in clean_errors(frame).collect()}
    assert (got[0].message, got[0].code, got[0].param) == ("m", "7", "True")
    assert all(got[i].message is None for i in (1, 2, 3, 4))


def test_redaction_comes_before_the_cut(spark):
    text = "x" * 995 + " sk-abcdefghijkl"
    frame = spark.createDataFrame([(text,)], "t string")
    out = frame.select(redact(F.col("t")).alias("r")).first().r
    assert len(out) == 1000 and "sk-" not in out


def test_requests_hold_the_payload_and_nothing_else(spark, sample, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps(sample, ensure_ascii=False))
    config = RunConfig("https://models.example/", "m", 'Vị trí "A"\nend', "0" * 64, 0.0, 100)
    rows = build_requests(read_questions(spark, str(path)), config).collect()
    assert len(rows) == 5
    for row in rows:
        story, place = map(int, row.key.split(":"))
        source = sample["data"][story]
        question = source["questions"][place]
        body = json.loads(row.body)
        assert body["messages"][0] == {"role": "system", "content": 'Vị trí "A"\nend'}
        assert json.loads(body["messages"][1]["content"]) == {
            "story": source["story"], "question": question["question"], "q_type": question["q_type"],
            "candidate_answers": question["candidate_answers"],
        }
        assert (body["model"], body["temperature"], body["max_completion_tokens"]) == ("m", 0.0, 100)
        schema = body["response_format"]["json_schema"]
        assert schema["strict"] is True and schema["schema"]["additionalProperties"] is False
        assert schema["schema"]["required"] == ["reasoning", "answer"]
        answer = schema["schema"]["properties"]["answer"]
        wanted = {
            "YN": ("string", ["Yes", "No", "DK"], 1, 1), "FR": ("integer", list(range(8)), 1, 8),
            "FB": ("string", ["C", "A", "B"], 0, 3), "CO": ("integer", [0, 1, 2, 3], 1, 1),
        }[question["q_type"]]
        assert (answer["items"]["type"], answer["items"]["enum"], answer["minItems"], answer["maxItems"]) == wanted
