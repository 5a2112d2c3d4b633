"""The compiled tokenizer against the library on made-up texts and on the test tables."""

import json
import os
import random

import numpy as np
import pytest

from answerframe.llm import token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
POOL = "'stmdrevlSTMDREVLxyz019 ,.!?-<>|\n\x00\téÉàßİΣσςñçöüÖ你好日本語한글əеЖ́̈ 　Ɤ①½٣😀'''"


@pytest.fixture(scope="module")
def counter():
    return token_counts.compile_tokenizer(PATH)


@pytest.fixture(scope="module")
def library():
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def made_up(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(POOL, k=rng.randint(0, 60))) for _ in range(n)]


def test_equals_library(counter, library):
    texts = made_up(4000, 1) + [
        None, "", " ", "<|endoftext|>a<|startoftext|><|endoftext|>", "<|endof<|endoftext|>text|>", "don't we're they'll I've 'rx 'r 'l 'll' ''s '' 're'",
        "'", "x'", "a" * 5000, "ab" * 3000, "the" * 2000, "'" * 700, "9" * 700, "ΑΣ Σ İ",
    ]
    assert counter.count(texts).tolist() == library(texts)


def test_few_states_give_the_same(counter, library, monkeypatch):
    monkeypatch.setattr(token_counts, "STATES", 300)
    fresh = token_counts.compile_tokenizer(PATH)
    texts = made_up(500, 2)
    assert fresh.count(texts).tolist() == library(texts)
    assert fresh.count(texts).tolist() == library(texts)


def test_scan_composes_maps():
    rng = np.random.default_rng(3)
    maps = rng.integers(0, 6, (37, 6)).astype(np.uint8)
    state, found = np.arange(6), token_counts.scan(maps)
    for k, one in enumerate(maps):
        state = one[state]
        assert found[k].tolist() == state.tolist()


@pytest.mark.parametrize("n", [1, 255, 256, 257, 1000])
def test_chunks_do_not_matter(n, monkeypatch):
    classes = np.append(np.random.default_rng(n).integers(0, 9, n), 0).astype(np.uint8)
    whole = token_counts.word_starts(classes)
    monkeypatch.setattr(token_counts, "CHUNK", 3)
    assert token_counts.word_starts(classes).tolist() == whole.tolist()


def test_operator(spark, library):
    big = 9007199254740993
    rows = [(big, "Two words.", 1), (None, None, 2), (7, "", 3), (big, "long " * 300_000 + "<|endoftext|>", 4), (7, "é日", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    found = token_counts.token_counts(docs, PATH, block_chars=50)
    want = [(i, len((t or "").encode()), n) for (i, t, _), n in zip(rows, library([t for _, t, _ in rows]), strict=True)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(docs.limit(0), PATH).count() == 0


def test_query_equals_library(spark, library):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    from answerframe.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = QUERIES["op12_token_counts"](spark, folder).collect()
    assert {r.doc_id: r.n_tokens for r in found} == dict(zip(texts, library(list(texts.values())), strict=True))
    assert all(r.over_limit == (r.n_tokens > 2048) and r.n_bytes == len((texts[r.doc_id] or "").encode()) for r in found)


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError):
        token_counts.compile_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"\p{L}+"}
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        token_counts.compile_tokenizer(str(tmp_path / "other.json"))
