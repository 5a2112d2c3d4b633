"""Cases of the second round's advice, each of which failed before."""

import numpy as np
from pyspark.sql import functions as F

from answerframe.llm import decontaminate, neighbours, pseudonyms


def words(n, offset=0):
    return " ".join(f"w{offset + i}" for i in range(n))


# --- decontamination -----------------------------------------------------------------------


def test_one_word_edits_leak_at_every_place():
    items = [words(n, 100 * n) for n in (9, 14, 24, 40, 59)]
    # The last words are rare and the others common, so that little of the impact is left without them.
    frequency = {w: 1 if int(w[1:]) % 100 >= n - n // 4 else 900 for n, t in zip((9, 14, 24, 40, 59), items, strict=True) for w in decontaminate.plain_words(t)}
    index = decontaminate.build(list(range(5)), items, frequency, 1000, retrieve=0.5, overlap=0.75)
    texts, want = [], set()
    for item, text in enumerate(items):
        own = text.split()
        for k in range(len(own)):
            edited = [*own[:k], "edit", *own[k + 1 :]]
            whole, kept = (decontaminate.shingles([w.encode() for w in ws]) for ws in (own, edited))
            if len(whole & kept) >= 0.75 * len(whole):
                want.add((len(texts), item))
            texts.append("x " * (k * 7) + " ".join(edited) + " y" * 100)
    found = {(t, index.ids[i]) for t, i, *_ in decontaminate.search(texts, index, 0.5, 0.75)}
    assert found == want and len(want) > 100


def test_two_edits_at_the_end_leak_though_few_answer_shingles_stay():
    item = words(40)
    index = decontaminate.build([1], [item], {}, 1, retrieve=0.5, overlap=0.75)
    edited = item.replace("w33 ", "edit ").replace("w39", "edit")
    (_, _, score, question, answer), = decontaminate.search([f"a b {edited} c"], index, 0.5, 0.75)
    assert question == 1.0 and answer < 0.75 and 0.9 < score < 1.0


# --- neighbours ----------------------------------------------------------------------------


def test_recall_stays_as_lists_become_more(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(8000, 16)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<float>")
    # 500 lists, of which a fixed number of probes would ask few.
    got = neighbours.search(frame, F.col("vec_id") % 100 == 0, list_size=16, probes=4).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 8000, 100):
        cosines = unit @ unit[q]
        cosines[q] = -9
        hits += len(set(np.argsort(-cosines)[:5].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 400 and hits >= 0.9 * 400


def test_all_centres_are_compared_when_many_are_asked_for():
    rng = np.random.default_rng(9)
    centres, x = (neighbours._unit(rng.normal(size=(n, 16))).astype(np.float32) for n in (700, 20))
    ids, cosines = neighbours.link(centres).nearest(x, 300)
    want = np.sort(x @ centres.T, axis=1)[:, ::-1][:, :300]
    assert ids.shape == (20, 300) and np.allclose(cosines, want, atol=1e-6)


def test_queries_with_few_results_ask_all_lists(spark):
    rng = np.random.default_rng(10)
    # Lists of one vector each, and a query that probes two of them only.
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<float>")
    got = neighbours.search(frame, F.col("vec_id") < 3, list_size=1, probes=2, probe_share=0.0, replicas=1).collect()
    for q in range(3):
        a = np.array(rows[q][1])
        cosines = {i: float(a @ np.array(v) / np.linalg.norm(v)) for i, v in rows if i != q}
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == sorted(cosines, key=cosines.get, reverse=True)[:5]


# --- pseudonyms ----------------------------------------------------------------------------


def test_values_beside_each_other_are_all_found_and_go_back(spark):
    cases = {
        "4111111111111111 12/25": ["card"], "12 4111111111111111": ["card"], "2024-01-02 2024-01-03": ["date", "date"],
        "123-45-6789 987-65-4321": ["social"], "123-45-6789 887-65-4321": ["social", "social"], "1980-05-04 123-45-6789": ["date", "social"],
        "4111 1111 1111 1111 2024-01-02": ["card", "date"], "269-555-3296 269-555-3297": ["phone", "phone"],
        "4111 1111 1111 1111 4012888888881881": ["card", "card"], "2020-01-01T10:00": ["date"], "4111-1111-1111-1111": ["card"], "2020-01-01Test": [],
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    made = pseudonyms.pseudonymize(docs, "k")
    got = {r.doc_id: r for r in made.collect()}
    assert [got[i].pii for i in range(len(cases))] == list(cases.values())
    first, second = (got[list(cases).index(t)].text for t in ("123-45-6789 987-65-4321", "1980-05-04 123-45-6789"))
    assert first.split()[0] == second.split()[1]
    assert {r.doc_id: r.text for r in pseudonyms.pseudonymize(made, "k", back=True).collect()} == dict(enumerate(cases))


# --- decontamination: third round ------------------------------------------------------------


def plain_leaks(rows, items, overlap=0.75):
    found = set()
    for d, text in rows:
        mine = decontaminate.plain_words(text)
        for i, item in items:
            own = decontaminate.plain_words(item)
            if own:
                size = min(5, len(own))
                wanted = decontaminate.shingles(own, size)
                if len(wanted & decontaminate.shingles(mine, size)) >= overlap * len(wanted):
                    found.add((d, i))
    return found


def test_first_three_quarters_of_an_item_leak(spark):
    big = 9007199254740993
    items = [(big, words(100, 1000)), (None, words(9, 5000)), (3, "w1 w2 w3")]
    cut = lambda n: words(n, 1000)
    rows = [(big + n, f"{'x ' * n * 3}{cut(n)} {'y ' * 200}") for n in (60, 75, 76, 80, 87, 99, 100)] + [(None, words(9, 5000)), (big, None), (7, "")]
    docs = spark.createDataFrame([(*r, "z", 1.0) for r in rows], "doc_id long, text string, item_id string, score double").coalesce(1)
    frame = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, frame).collect()}
    assert found == plain_leaks(rows, items) and (big + 80, big) in found and (None, None) in found


def test_scores_do_not_depend_on_blocks(spark):
    items = spark.createDataFrame([(i, words(8 + i, 100 * i)) for i in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(i, words(8 + i, 100 * i) + " tail") for i in range(12)], "doc_id long, text string")
    one, many = (sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in decontaminate.leaks(docs, items, block_items=n).collect()) for n in (100, 3))
    assert one == many and len(one) == 12
