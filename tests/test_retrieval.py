import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone import session
from lodestone.operators import bm25, chunking, overlap

DOCS = [
    "alpha beta gamma", "alpha beta", "alpha", "the the the fox", "Mary's lamb and mary s lamb, mary's",
    "a a a a", "unrelated words here", "x" * 700 + "needle" + "y" * 700, "state of the art: state-of-the-art",
]
QUERIES = [
    "alpha beta gamma", "mary's", "a/a the", "state.of the the", "needle", "?", "  ", '"alpha"* (beta) +gamma -x',
    "zzz", "lamb lamb art",
]


def frames(spark, docs=DOCS, queries=QUERIES):
    return (
        spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"),
        spark.createDataFrame(list(enumerate(queries)), "qid long, query string"),
    )


def bm25_brute(docs, queries, k):
    tok = lambda s: [t for t in re.split(r"[^0-9a-z]+", s.lower()) if t]
    toks = [tok(d) for d in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    out = []
    for qid, q in enumerate(queries):
        phrases = [tok(w) for w in re.sub(r'["*()\-+^:]', " ", q).split()]
        scores = {}
        for p in filter(None, phrases):
            tf = {}
            for d, t in enumerate(toks):
                c = sum(t[i:i + len(p)] == p for i in range(len(t)))
                if c:
                    tf[d] = c
            idf = math.log((n - len(tf) + 0.5) / (len(tf) + 0.5))
            idf = idf if idf > 0 else 1e-6
            for d, c in tf.items():
                norm = 1.2 * (0.25 + 0.75 * len(toks[d]) / avg)
                scores[d] = scores.get(d, 0) + idf * c * 2.2 / (c + norm)
        ranked = sorted(scores.items(), key=lambda x: (-round(x[1], 10), x[0]))[:k]
        out += [(qid, i + 1, d, round(s, 8)) for i, (d, s) in enumerate(ranked)]
    return out


def got(df):
    return sorted((r.qid, r["rank"], r.doc_id, round(r.score, 8)) for r in df.collect())


@pytest.mark.parametrize("limit", [None, 0])
def test_bm25_matches_brute_force(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(bm25, "BROADCAST_BYTES", -1)
    docs, queries = frames(spark)
    want = bm25_brute(DOCS, QUERIES, 3)
    assert got(bm25.bm25_search(docs, queries, 3)) == want
    lengths = bm25.tokenized(docs).select("doc_id", "dl")
    assert got(bm25.bm25_search_index(bm25.build_postings(docs), lengths, queries, 3)) == want


def test_bm25_ranks_the_fullest_document_first(spark):
    docs, queries = frames(spark, queries=["alpha beta gamma"])
    assert [r[2] for r in got(bm25.bm25_search(docs, queries, 5))] == [0, 1, 2]


@pytest.mark.parametrize("limit", [session.BROADCAST_BYTES, -1])
def test_overlap_matches_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(session, "BROADCAST_BYTES", limit)
    rng = random.Random(5)
    letters = "abéc "
    docs = DOCS + ["".join(rng.choice(letters) for _ in range(40)) or "a" for _ in range(60)]
    queries = QUERIES + ["".join(rng.choice(letters) for _ in range(8)) for _ in range(12)]
    want = []
    for qid, q in enumerate(queries):
        tokens = [t.lower() for t in q.split()]
        scored = [(sum(t in d.lower() for t in tokens), i) for i, d in enumerate(docs)]
        best = sorted((s for s in scored if s[0]), key=lambda x: (-x[0], x[1]))[:4]
        want += [(qid, r + 1, i, s) for r, (s, i) in enumerate(best)]
    assert got(overlap.overlap_search(*frames(spark, docs, queries), 4)) == want


def test_chunks_overlap_and_end_with_the_text(spark):
    texts = [" ".join(map(str, range(n))) for n in (1, 6, 7, 10, 25)] + ["  "]
    docs, _ = frames(spark, texts)
    want = []
    for d, text in enumerate(texts):
        words, start, no = text.split(), 0, 0
        while start < len(words):
            want.append((d, no, " ".join(words[start:start + 6])))
            if start + 6 >= len(words):
                break
            start, no = start + 4, no + 1
    rows = chunking.chunk_documents(docs, 6, 2).collect()
    assert sorted((r.doc_id, r.chunk_no, r.chunk) for r in rows) == want
    assert [c for d, n, c in want if (d, n) == (3, 1)][0].startswith("4 5")
    with pytest.raises(ValueError):
        chunking.chunk_documents(docs, 5, 5)


def test_scan_reads_only_what_it_needs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = chunking.chunk_documents(docs, 300, 50)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_top_k_is_cut_before_the_shuffle(spark):
    from lodestone.operators.ranking import top_k

    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    plan = top_k(df, ["g"], [F.asc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
