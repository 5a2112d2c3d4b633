"""Scores, reports, losses and decoding."""

import math
import random

import pytest
from pyspark.sql import functions as F

from answerframe.functions.decode import decode
from answerframe.functions.labels import encode_labels
from answerframe.functions.metrics import answer_matches, set_jaccard
from answerframe.operators.infer import masked_mean_pool
from answerframe.operators.runs import best_epoch
from answerframe.operators.score import (
    macro_score,
    mean_loss,
    multitask_loss,
    per_file_metrics,
    primary_score,
    run_report,
    score,
)

PAIRS = "q_type string, prediction array<string>, gold array<string>"


def _by_task(frame):
    return {r.q_type: r.asDict() for r in frame.collect()}


def test_answered_only_scores(spark):
    rows = [
        ("CO", ["3"], ["1"]), ("CO", ["1"], ["1"]), ("CO", ["0"], ["0"]), ("CO", ["2"], None), ("YN", ["No"], ["No"]), ("YN", None, ["DK"]),
        ("FR", ["0", "4", "6"], ["4"]), ("FB", ["C"], ["C"]), ("FB", ["A", "C"], ["B"]), ("FB", None, ["A"]),
    ]
    got = _by_task(score(spark.createDataFrame(rows, PAIRS), missing="skip"))
    assert {t: r["count"] for t, r in got.items()} == {"CO": 3, "YN": 1, "FR": 1, "FB": 2}
    assert got["CO"]["accuracy"] == pytest.approx(2 / 3) and got["YN"]["accuracy"] == 1.0 and got["YN"]["jaccard"] is None
    assert (got["FR"]["exact_match"], got["FR"]["jaccard"], got["FR"]["accuracy"]) == (0.0, pytest.approx(1 / 3), None)
    assert (got["FB"]["exact_match"], got["FB"]["jaccard"]) == (0.5, 0.5)
    assert score(spark.createDataFrame([], PAIRS), missing="skip").count() == 0


def test_question_scores(spark):
    """All pairs of subsets of three labels, written in any order and with repeats."""
    subsets = [[x for k, x in enumerate("361") if bits >> k & 1] for bits in range(8)]
    rows = [("FR", p[::-1] + p[:1], g) for p in subsets for g in subsets]
    frame = spark.createDataFrame(rows, PAIRS)
    got = frame.select("*", set_jaccard(F.col("prediction"), F.col("gold")).alias("j"), answer_matches(F.col("q_type"), F.col("prediction"), F.col("gold")).alias("m"))
    for r in got.collect():
        p, g = set(r.prediction), set(r.gold)
        assert r.j == pytest.approx(len(p & g) / len(p | g) if p | g else 1.0) and r.m == (p == g)
    single = spark.createDataFrame([("CO", ["2"], ["3"]), ("YN", ["DK"], ["DK"])], PAIRS)
    assert [r[0] for r in single.select(answer_matches(F.col("q_type"), F.col("prediction"), F.col("gold"))).collect()] == [False, True]


def test_missing_is_wrong_even_for_empty_gold(spark):
    rows = [("FB", None, []), ("FB", [], []), ("YN", None, ["Yes"]), ("CO", ["1"], None)]
    got = _by_task(score(spark.createDataFrame(rows, PAIRS), missing="wrong"))
    assert got["FB"] == {"q_type": "FB", "count": 2, "answered": 1, "accuracy": None, "exact_match": 0.5, "jaccard": 0.5}
    assert got["YN"]["accuracy"] == 0.0 and got["YN"]["answered"] == 0 and "CO" not in got


def test_score_wants_a_stated_denominator(spark):
    with pytest.raises(ValueError):
        score(spark.createDataFrame([], PAIRS), missing="maybe")


def test_scores_agree_with_plain_python(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        task = rng.choice(["YN", "FR", "FB", "CO"])
        pool = {"YN": ["Yes", "No", "DK"], "FR": list("01234567"), "FB": list("ABC"), "CO": list("0123")}[task]

        def pick():
            return [rng.choice(pool)] if task in ("YN", "CO") else rng.sample(pool, rng.randint(0, 3))

        rows.append((task, pick() if rng.random() < 0.8 else None, pick() if rng.random() < 0.9 else None))
    wanted = {}
    for task, p, g in rows:
        if g is None:
            continue
        w = wanted.setdefault(task, [0, 0, 0, 0.0])
        w[0] += 1
        if p is not None:
            w[1] += 1
            w[2] += (p == g) if task in ("YN", "CO") else (set(p) == set(g))
            w[3] += len(set(p) & set(g)) / len(set(p) | set(g)) if set(p) | set(g) else 1.0
    frame = spark.createDataFrame(rows, PAIRS)
    for variant in (frame, frame.repartition(7), frame.orderBy(F.rand(3))):
        got = _by_task(score(variant, missing="wrong"))
        for task, (n, answered, hits, jaccard) in wanted.items():
            assert (got[task]["count"], got[task]["answered"]) == (n, answered)
            if task in ("YN", "CO"):
                assert got[task]["accuracy"] == pytest.approx(hits / n)
            else:
                assert got[task]["exact_match"] == pytest.approx(hits / n)
                assert got[task]["jaccard"] == pytest.approx(jaccard / n)
                assert 0 <= got[task]["exact_match"] <= got[task]["jaccard"] + 1e-12 <= 1 + 1e-9
    full = frame.filter("prediction is not null")
    skip, wrong = _by_task(score(full, "skip")), _by_task(score(full, "wrong"))
    assert all(skip[t]["accuracy"] == wrong[t]["accuracy"] and skip[t]["jaccard"] == wrong[t]["jaccard"] for t in skip)


def test_macro_primary_and_per_file(spark):
    rows = [("h", "YN", ["Yes"], ["Yes"]), ("a", "YN", ["Yes"], ["No"]), ("a", "YN", ["No"], ["No"]), ("a", "FR", ["1"], ["1"]), ("n", "YN", ["No"], None)]
    frame = spark.createDataFrame(rows, "source_file string, " + PAIRS)
    macro = _by_task(macro_score(frame, "skip", dataset="source_file"))
    assert macro["YN"]["accuracy"] == 0.75 and macro["YN"]["datasets"] == 2
    pooled = score(frame, "skip")
    assert _by_task(pooled)["YN"]["accuracy"] == pytest.approx(2 / 3)
    assert primary_score(pooled).first().primary_score == pytest.approx((2 / 3 + 1) / 2)
    assert primary_score(score(frame.limit(0), "skip")).first().primary_score == 0.0
    files = {r.source_file: r.by_task for r in per_file_metrics(frame).collect()}
    assert set(files) == {"h", "a"} and files["a"]["FR"]["exact_match"] == 1.0 and set(files["h"]) == {"YN"}


def test_run_report(spark):
    rows = [
        ("FR", ["1", "6"], ["1", "6"]), ("FR", None, ["0"]), ("CO", ["1"], ["2"]), ("FB", ["B", "C"], ["C"]), ("FB", ["A"], ["A"]),
        ("YN", None, ["DK"]), ("CO", ["3"], None), ("CO", ["0"], ["0"]),
    ]
    attempts = spark.createDataFrame(
        [("a", (40, 2, 42)), ("b", None), ("c", (3, None, 3))],
        "key string, usage struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint>",
    )
    report = run_report(spark.createDataFrame(rows, PAIRS), attempts, evaluation="trial").first()
    assert (report.selected_questions, report.answered_questions, report.coverage, report.status) == (8, 6, 0.75, "partial") and report.evaluation == "trial"
    assert report.by_task["YN"].accuracy == 0.0 and report.by_task["FR"].exact_match == 0.5 and report.by_task["FR"].jaccard == 0.5
    assert report.by_task["FB"].jaccard == 0.75 and report.by_task["CO"].accuracy == 0.5 and report.by_task["CO"]["count"] == 2
    assert report.usage_all_attempts.asDict() == {"prompt_tokens": 43, "completion_tokens": 2, "total_tokens": 45}
    nothing = run_report(spark.createDataFrame([], PAIRS)).first()
    assert (nothing.selected_questions, nothing.coverage, nothing.by_task) == (0, 0.0, {})
    unlabelled = run_report(spark.createDataFrame([("YN", ["Yes"], None)], PAIRS)).first()
    assert unlabelled.status == "complete" and unlabelled.by_task == {}


def test_label_vectors(spark):
    rows = [
        ("YN", ["No"], []), ("YN", [], []), ("CO", ["2"], []), ("CO", [], []), ("FR", ["0", "7"], []), ("FB", ["A", "Z"], ["A", "C"]),
        ("FB", ["B"], []), ("FB", ["B"], ["A"]),
    ]
    frame = spark.createDataFrame(rows, "q_type string, l array<string>, c array<string>")
    got = [r.e for r in frame.select(encode_labels(F.col("q_type"), F.col("l"), F.col("c")).alias("e")).collect()]
    assert [g.yn_label for g in got[:3]] == [1, 2, -100] and [g.co_label for g in got[1:4]] == [-100, 2, 3]
    assert got[4].fr_label == [1, 0, 0, 0, 0, 0, 0, 1] and got[4].fr_mask == [1] * 8 and got[0].fr_mask == [0] * 8
    assert (got[5].fb_label, got[5].fb_mask) == ([1, 0, 0], [1, 0, 1])
    assert (got[6].fb_label, got[6].fb_mask) == ([0, 1, 0], [1, 1, 1])
    assert (got[7].fb_label, got[7].fb_mask) == ([0, 1, 0], [1, 0, 0])
    with pytest.raises(Exception, match="unknown YN label"):
        bad = spark.createDataFrame([("YN", ["Maybe"], [])], "q_type string, l array<string>, c array<string>")
        bad.select(encode_labels(F.col("q_type"), F.col("l"), F.col("c"))).collect()


def test_decoding(spark):
    schema = "q_type string, yn array<float>, co array<float>, fr array<float>, fb array<float>, c array<string>"
    none = [-9.0] * 8
    rows = [
        ("YN", [1.0, 3.0, 3.0], [0.0] * 4, none, [0.0] * 3, []),
        ("CO", [0.0] * 3, [1.0, 1.0, 5.0, 5.0], none, [0.0] * 3, []),
        ("FR", [0.0] * 3, [0.0] * 4, [-1.0, 0.0, 2.0, -3.0, -3.0, -3.0, -3.0, 1.0], [0.0] * 3, []),
        ("FR", [0.0] * 3, [0.0] * 4, [-5.0, -2.0, -2.0] + [-6.0] * 5, [0.0] * 3, []),
        ("FB", [0.0] * 3, [0.0] * 4, none, [1.0, -1.0, 0.0], []),
        ("FB", [0.0] * 3, [0.0] * 4, none, [1.0, 1.0, 1.0], ["C", "D", "A", "A"]),
        ("FB", [0.0] * 3, [0.0] * 4, none, [-1.0, -1.0, -1.0], ["A"]),
    ]
    frame = spark.createDataFrame(rows, schema)
    picked = decode(F.col("q_type"), F.col("yn"), F.col("co"), F.col("fr"), F.col("fb"), F.lit(0.5), F.col("c"))
    assert [r.p for r in frame.select(picked.alias("p")).collect()] == [
        ["No"], ["2"], ["1", "2", "7"], ["1"], ["A", "C"], ["C", "A", "A"], [],
    ]


def test_losses(spark):
    big = 800.0
    rows = [
        ("YN", [0.0, 0.0, 0.0], ["Yes"], []), ("YN", [big, 0.0, 0.0], ["No"], []),
        ("FB", [big, -big, 0.0], ["A"], ["A", "B"]),
    ]
    frame = spark.createDataFrame(rows, "q_type string, x array<float>, l array<string>, c array<string>").select(
        "q_type", F.col("x").alias("yn"), F.array(*[F.lit(0.0)] * 4).alias("co"), F.array(*[F.lit(0.0)] * 8).alias("fr"),
        F.col("x").alias("fb"), encode_labels(F.col("q_type"), F.col("l"), F.col("c")).alias("labels"),
    )
    got = {r.q_type: r.loss for r in multitask_loss(frame).collect()}
    assert got["YN"] == pytest.approx((math.log(3) + big) / 2) and got["FB"] == pytest.approx(0.0)
    assert mean_loss(multitask_loss(frame)).first().loss == pytest.approx((math.log(3) + big) / 4)


def test_best_epoch_takes_the_earliest_of_equals(spark):
    rows = [("r", 1, 0.5), ("r", 2, 0.7), ("r", 3, 0.7), ("s", 1, 0.0)]
    got = best_epoch(spark.createDataFrame(rows, "run string, epoch int, primary_score double")).collect()
    assert {(r.run, r.epoch, r.primary_score) for r in got} == {("r", 2, 0.7), ("s", 1, 0.0)}


def test_pooling_ignores_padding(spark):
    rows = [([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])]
    frame = spark.createDataFrame(rows, "h array<array<float>>, m array<int>")
    assert [r.p for r in frame.select(masked_mean_pool("h", "m").alias("p")).collect()] == [[2.0, 3.0], [0.0, 0.0]]
