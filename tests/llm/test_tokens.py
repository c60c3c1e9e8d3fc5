"""The trie encoder against an independent encoder of the same vocabulary, and exact round trips."""

import random

import duckdb
import pytest

from sheaf.llm import tokens

tiktoken = pytest.importorskip("tiktoken")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def known():
    path, pattern = tokens.default_vocabulary()
    ranks = tokens.read_ranks(path)
    return ranks, pattern, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def check(known, texts):
    ranks, pattern, enc = known
    o, i = tokens.TrieEncoder(ranks, pattern).encode(texts)
    text_of = {v: k for k, v in ranks.items()}
    for k, t in enumerate(texts):
        ids = list(i[o[k] : o[k + 1]])
        assert ids == (enc.encode_ordinary(t) if t else [])
        assert b"".join(text_of[x] for x in ids).decode() == (t or "")


def test_odd_texts(known):
    random.seed(2)
    check(known, [None, "", " ", "\n\n", "a" * 3000, "é" * 1000, "​" * 50, " " * 3000, "<|endoftext|>", "𝔘𝔫𝔦" * 100, "I'll we've\t don't", "ab12" * 500, "مرحبا 你好"])
    check(known, ["".join(random.choice("abcde fghi.,-_01é中\n") for _ in range(500)) for _ in range(40)])


def test_forgetting_words_changes_nothing(known, monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_WORDS", 3)
    ranks, pattern, enc = known
    e = tokens.TrieEncoder(ranks, pattern)
    for t in ("one two three four", "five two six", "one two seven"):
        o, i = e.encode([t])
        assert list(i) == enc.encode_ordinary(t)


def test_corpus(spark, data, known):
    d = duckdb.sql(f"select doc_id, text from '{data}/documents.parquet'").fetchall()
    got = {r.doc_id: r.ids for r in tokens.encode(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    assert got == {i: (known[2].encode_ordinary(t) if t else []) for i, t in d}
    n = {r.doc_id: r.n_tokens for r in tokens.count(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    assert n == {i: len(x) for i, x in got.items()}


def test_edges(spark):
    d = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "a", "z"), (2, "a", "z")], "doc_id int, text string, ids string")
    assert sorted((str(r.doc_id), list(r.ids)) for r in tokens.encode(d).collect()) == [("1", []), ("1", []), ("2", [64]), ("None", [64])]
    assert tokens.encode(d.limit(0)).collect() == []
