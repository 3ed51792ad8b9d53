"""Substring matches against Python's own, with tokens and words of any length."""

import random

import pytest

from lodestone.operators.overlap import overlap_search
from lodestone.operators.substring import gram_table, number_tokens, substring_matches


def _pairs(spark, texts, tokens):
    table = number_tokens(spark.createDataFrame([(t,) for t in tokens], "token string"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hits = substring_matches(docs, "doc_id", "text", table).join(table, "token_no").select("doc_id", "token").collect()
    assert len(hits) == len(set(hits))
    return {(row.doc_id, row.token) for row in hits}


def _brute(texts, tokens):
    return {(i, t) for i, text in enumerate(texts) if text for t in set(tokens) if any(t in w for w in text.lower().split())}


@pytest.mark.parametrize("seed", range(3))
def test_random_words(spark, seed):
    """Few letters, so that grams repeat within tokens and tokens lie inside one another."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abé𝄞") for _ in range(n))
    texts = [" ".join(word(rng.randint(1, 30)) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, "", " \t"]
    tokens = [word(rng.randint(1, 14)) for _ in range(80)] + [texts[0].split()[0] if texts[0] else "a"]
    assert _pairs(spark, texts, tokens) == _brute(texts, tokens)


def test_tokens_and_words_longer_than_a_piece(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    texts = [f"x {long} y", long[5_000:14_999], long[5_000:15_000], "abc"]
    tokens = [long[5_000:15_000], long[240:270], long[255:263], long[19_992:], long[256:257], "abcd" * 3_000]
    assert _pairs(spark, texts, tokens) == _brute(texts, tokens)


def test_no_tokens_and_no_texts(spark):
    assert _pairs(spark, ["a b"], []) == set()
    assert _pairs(spark, [], ["a"]) == set()


def test_one_gram_per_token(spark):
    tokens = ["a", "abcdefgh", "abcdefghij", "abcdefghik", "z" * 500]
    numbered = number_tokens(spark.createDataFrame([(t,) for t in tokens], "token string"))
    rows = {row.token: row.gram for row in gram_table(numbered).collect()}
    assert rows == {"a": "a", "abcdefgh": "abcdefgh", "abcdefghij": "cdefghij", "abcdefghik": "cdefghik", "z" * 500: "z" * 8}


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr("lodestone.session.BROADCAST_BYTES", -1)
    texts, tokens = ["Alphabetical order", "betting", None], ["bet", "alphabetical", "order", "ting", "alphabetic"]
    assert _pairs(spark, texts, tokens) == _brute(texts, tokens)
    asked = spark.createDataFrame([(1, "bet bet order")], "qid long, query string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [tuple(r) for r in overlap_search(docs, asked, 5).orderBy("rank").collect()] == [(1, 1, 0, 3), (1, 2, 1, 2)]
