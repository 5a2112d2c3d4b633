"""Ids beside nulls, very long values and deep pages, each of which failed or changed before."""

import tracemalloc

import pytest
from pyspark.sql import functions as F

from answerframe.llm import extract, language, near_duplicates, pseudonyms, secrets, toxicity

BIG = 9007199254740993
TEXTS = [(BIG, "the house and the garden were quiet"), (None, "password = hunter2hunter2x"), (BIG + 2, "the house and the garden were quiet"), (None, None), (-BIG, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, i, None, "de" if i % 2 else "en") for i, r in enumerate(TEXTS)], "doc_id long, text string, n int, more short, lang string").coalesce(1)


def ids(frame, name="doc_id"):
    return sorted((r[name] for r in frame.select(name).collect()), key=repr)


WANT = sorted((i for i, _ in TEXTS), key=repr)


def test_ids_stay_beside_nulls(spark, docs):
    found = secrets.scan(docs, None)
    assert ids(found) == WANT and found.schema["n"].dataType == docs.schema["n"].dataType and found.schema["more"].dataType == docs.schema["more"].dataType
    assert ids(language.identify(docs, language.train(docs))) == WANT
    labels = spark.createDataFrame([(BIG, 1), (BIG + 2, 0)], "doc_id long, toxic int")
    assert ids(toxicity.score(docs, toxicity.train(docs, labels))) == WANT
    near = near_duplicates.near_duplicates(docs)
    assert ids(near) == WANT and {r.component_id for r in near.filter(F.col("doc_id") >= BIG).collect()} == {BIG}
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/c").alias("url"), F.col("text").alias("html"))
    assert ids(extract.extract(pages), "page_id") == WANT


def test_long_values_do_not_stop_spark(spark):
    mail = "someone@" + ".".join(["label"] * 100_000)
    text = f"write to {mail} or 4111111111111111 {'9' * 100_000} {'1-' * 50_000} a@b.cd"
    frame = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in pseudonyms.pseudonymize(frame, key="k").collect()}
    assert rows[2] is None and rows[3] == "" and mail not in rows[1] and "4111111111111111" not in rows[1]
    assert pseudonyms.pseudonymize(frame.limit(0), key="k").count() == 0


def test_deep_pages_take_little_memory():
    html = "<div>" * 20_000 + "deep" + "<p>more"
    tracemalloc.start()
    found = extract.blocks_of(html)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert [b[1] for b in found] == ["deep", "more"] and most < 50_000_000
