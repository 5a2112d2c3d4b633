"""What the secret network learns from: every example, in parts of bounded size."""

import numpy as np
from pyspark.sql import functions as F

from answerframe.llm import secrets


def texts(n, n_secrets, seed=1):
    """Each with a plain run of its own, the first ones with a key too."""
    rng = np.random.default_rng(seed)
    out = []
    for i, word in enumerate(rng.integers(97, 123, (n, 14), dtype=np.uint8)):
        key = "".join(rng.choice(list("0123456789abcdef"), 32)) if i < n_secrets else "no key"
        out.append((i, f"see {word.tobytes().decode()} or {key} here"))
    return out


def test_secrets_too_few_for_a_sample_are_learned(spark):
    rows = texts(60_000, 40)
    net = secrets.train(spark.createDataFrame(rows, "doc_id long, text string"))
    assert net is not None
    key = "sk_live_0123456789abcdef0123XYZQW"
    assert key in {f"see {key} here"[a:b] for a, b, _ in secrets._spans([f"see {key} here"], net)[0]}


def test_every_example_is_dealt_once_and_copies_fill_parts(spark):
    rows = [*texts(3000, 30), (None, None), (None, ""), (7, "see " + "abcdefghijkl" * 20 + " é"), (7, "see " + "abcdefghijkl" * 20 + " é")]
    found = secrets.examples(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    want = {
        (secrets.encode([w])[0].tobytes(), y)
        for _, t in rows
        for a, b, y in secrets.labelled(t or "", secrets.base_spans(t or ""))
        for w in secrets.windows(t, a, b)
    }
    assert sorted((bytes(r.codes), r.label) for r in found.collect()) == sorted(want)
    packed, counts, n_parts = secrets.dealt(found, 100)
    assert n_parts > 10 and sum(counts.values()) == len(want)
    got, sides = [], {}
    for r in packed.collect():
        _, codes, labels, own = next(secrets._unpacked([packed.filter((F.col("part") == r.part) & (F.col("held") == r.held)).toPandas()]))
        got += [(c.tobytes(), int(y)) for c, y in zip(codes[own], labels[own], strict=True)]
        sides.setdefault(r.held, []).append(int((labels == 1).sum()))
    assert sorted(got) == sorted(want)
    # So few secrets are in every part.
    assert all(set(n) == {counts[held, 1]} for held, n in sides.items())


def test_parts_in_any_order_give_the_same_network(spark):
    docs = spark.createDataFrame(texts(900, 60), "doc_id long, text string")
    one = secrets.train(docs.repartition(1), part_size=150)
    other = secrets.train(docs.repartition(7).sortWithinPartitions(F.desc("doc_id")), part_size=150)
    assert all(np.array_equal(getattr(one, k), getattr(other, k)) for k in secrets._LEARNED) and one.threshold == other.threshold


def test_gradients_equal_differences_of_the_loss():
    rng = np.random.default_rng(0)
    codes, labels, weight = rng.integers(0, 98, (64, secrets._LENGTH)).astype(np.uint8), rng.integers(0, 2, 64), rng.random(64)
    net = secrets.untrained()

    def loss(name, place, by):
        values = np.asarray(getattr(net, name), dtype=np.float64).copy()
        values[place] += by
        z = secrets.replace(net, **{name: values}).forward(codes)[3].astype(np.float64)
        return ((np.logaddexp(0, z) - labels * z) * weight).mean()

    for name, got in secrets.gradients(net, codes, labels, weight).items():
        got = np.asarray(got)
        place = np.unravel_index(np.abs(got).argmax(), got.shape)
        assert np.isclose(got[place], (loss(name, place, 1e-3) - loss(name, place, -1e-3)) / 2e-3, rtol=0.05), name


def test_counted_scores_set_the_threshold_of_single_ones():
    rng = np.random.default_rng(2)
    z, labels = np.round(rng.normal(0, 2, 500), 1), rng.integers(0, 2, 500)
    z = z + 2 * labels
    places, counts = np.unique(np.stack([z, labels]), axis=1, return_counts=True)
    one = secrets.calibrate_counted(secrets.untrained(), z, labels, np.ones(500), 0.9)
    other = secrets.calibrate_counted(secrets.untrained(), places[0], places[1].astype(int), counts.astype(float), 0.9)
    assert np.allclose([one.slope, one.shift, one.threshold], [other.slope, other.shift, other.threshold])
    p = 1 / (1 + np.exp(-(one.slope * z + one.shift)))[labels == 1]
    assert np.isclose(np.sort(p)[int(0.1 * len(p))], one.threshold)
