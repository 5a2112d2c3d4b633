"""The secret network: which runs it is asked about, what it adds, and the patterns read another way."""

import string
import time

import numpy as np
import pytest

from answerframe.llm import secrets

ALPHABETS = [string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters]


def sentence(rng, n=12):
    vocabulary = "the quiet house and a garden internationalization responsibilities state-of-the-art Donaudampfschifffahrt 2024-01-02 example.org/en/news WELLESTABLISHED".split()
    return " ".join(rng.choice(vocabulary, n))


@pytest.fixture(scope="module")
def net(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        key = "".join(rng.choice(list("0123456789abcdef"), rng.integers(20, 41)))
        rows.append((i, f"{sentence(rng)} {('token = ', 'sum ', 'api_key: ')[i % 3]}{key.upper() if i % 5 == 0 else key} {sentence(rng)}"))
    return secrets.train(spark.createDataFrame(rows, "doc_id long, text string"))


def test_planted_keys_are_found_whole(net):
    rng, hits, wrong = np.random.default_rng(5), 0, 0
    for i in range(200):
        key = ("", "sk_live_", "xoxb-")[i % 3] + "".join(rng.choice(list(ALPHABETS[i % 4]), rng.integers(20, 45)))
        before = sentence(rng) + " "
        text = f"{before}{key} {sentence(rng)}"
        found = secrets._spans([text], net)[0]
        hits += any(a <= len(before) and b >= len(before) + len(key) for a, b, _ in found)
        wrong += sum(k == "net" and not (a < len(before) + len(key) and len(before) < b) for a, b, k in found)
    assert hits >= 180 and wrong <= 4
    text = "see sk_live_0123456789abcdef0123XYZQW there"
    assert secrets.redact(text, secrets._spans([text], net)[0], "#") == "see # there"


def test_whole_texts_are_encoded_like_their_pieces():
    text = "é\n" + "a" * 13 + " \x07" + "Xy9_" * 40 + "\U0001f600 end" + "q" * 14
    padded = np.concatenate([np.zeros(secrets.AROUND, np.uint8), secrets.classes(text), np.zeros(secrets._LENGTH, np.uint8)])
    for a, b in secrets.candidates(text):
        starts = np.arange(a, b, secrets.WIDTH)
        assert (secrets.encode_at(padded, starts, np.minimum(starts + secrets.WIDTH, b)) == secrets.encode(secrets.windows(text, a, b))).all()
    assert len(secrets.candidates(text)) == 3


def test_looked_up_scores_equal_the_forward_pass(net):
    codes = np.random.default_rng(6).integers(0, 98, (300, secrets._LENGTH)).astype(np.uint8)
    assert np.allclose(net.scores(codes), net.forward(codes)[3], atol=1e-3)


def test_labels():
    text = "The responsibilities of token abcdefghijklmn; 0123456789abcdef x Kj3kLm9PqRs7Tu internationalization"
    base = secrets.base_spans(text)
    got = {text[a:b]: y for a, b, y in secrets.labelled(text, base)}
    assert got == {"responsibilities": 0, "0123456789abcdef": 1, "internationalization": 0}
    many = " ".join(["0123456789abcdef0"] * 40_000)
    start = time.time()
    assert sum(y for _, _, y in secrets.labelled(many, secrets.base_spans(many))) == 40_000 and time.time() - start < 5
    assert secrets.labelled("A" * 200_000 + "_" * 200_000 + "!", []) is not None


def test_scan_with_network_on_edges(spark, net):
    rows = [(1, None, "x", 3), (2, "", "x", 3), (None, "a" * 1_000_000, None, None), (None, "a" * 1_000_000, None, None), (5, "퟿\n" * 1000, "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, secrets string, start int")
    got = secrets.scan(docs, net, mask="#").collect()
    assert len(got) == 5 and got[0].asDict().keys() == {"doc_id", "text", "secrets", "start"} and {r.text for r in got if r.doc_id == 1} == {None}
    assert secrets.scan(docs.limit(0), net).count() == 0
    alike = [(r.text, r.secrets) for r in got if r.doc_id is None]
    assert alike[0] == alike[1]


def plain_patterns(text):
    """The contract read character by character, without regular expressions."""
    out, letters = [], string.ascii_letters + string.digits
    value = set(letters + "+/_.=-")
    low = "".join(c.lower() if c in string.ascii_uppercase else c for c in text)

    def run(at, allowed):
        end = at
        while end < len(text) and text[end] in allowed:
            end += 1
        return end

    def assign(at):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(word, at):
                k = at + len(word)
                k += text[k : k + 1] in ("'", '"')
                k = run(k, " ")
                if text[k : k + 1] not in (":", "="):
                    continue
                k = run(k + 1, " ")
                k += text[k : k + 1] in ("'", '"')
                end = run(k, value)
                if end > k:
                    return k, end
        return None

    at = 0
    while at < len(text):
        found = assign(at)
        if found and found[1] - found[0] >= 12:
            out.append((at, found[1], "assign"))
        at = found[1] if found else at + 1
    for kind, prefix, allowed, least in (("access", "AKIA", set(string.ascii_uppercase + string.digits), 18), ("hex", "", set("0123456789abcdef"), 16)):
        at = 0
        while at < len(text):
            end = run(at + len(prefix), allowed) if text.startswith(prefix, at) else at
            if end > at + len(prefix) and end - at >= least:
                out.append((at, end, kind))
            at = end if end > at + len(prefix) else at + 1
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_patterns_equal_a_reading_by_character():
    rng = np.random.default_rng(3)
    pieces = ["password", "Secret", "api_key", "APIKEY", "token", "'", '"', " ", "  ", ":", "=", "==", "abcdef123456", "0123456789abcdef", "AKIA", "AKIAABCDEFGHIJ1234", "Zz", "\n", "é", "ſ", "K", ".", "x" * 13]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, rng.integers(1, 12)))
        assert secrets.base_spans(text) == plain_patterns(text), text
