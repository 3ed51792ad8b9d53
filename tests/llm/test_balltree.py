"""Ranked search against brute force, and the bounds of the tree."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import balltree

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if text else []


def brute(docs, items, k):
    held = [(d, Counter(words(t))) for d, t in docs if words(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for d, c in held:
            if d is None:
                continue
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, d))
        out += [(item, rank + 1, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def corpus():
    r = random.Random(5)
    vocabulary = [f"w{int(r.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 80)))) for i in range(500)]
    docs += [(600 + i, docs[0][1]) for i in range(80)]  # more ties than k
    docs += [(3, "Größe W1 w2-W3"), (3, "Größe W1 w2-W3"), (None, "w1 w2"), (900, None), (901, ""), (902, " .,; "), (903, "w1 " * 30_000)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 30)))) for i in range(12)]
    items += [(20, docs[0][1]), (21, None), (22, ""), (None, "w1"), (23, "nowhere unseen"), (24, "größe GRÖSSE w1"), (25, "w1"), (25, "w2 w2")]
    return docs, items


@pytest.mark.parametrize("part_pairs", [10**6, 20])
def test_equals_brute_force(spark, part_pairs):
    docs, items = corpus()
    left = spark.createDataFrame([(d, t, 1, 2.0) for d, t in docs], "doc_id long, text string, rank int, score double").repartition(3)
    right = spark.createDataFrame([(i, t, "t") for i, t in items], "item_id long, text string, term string")
    got = balltree.ranked(left, right, k=7, part_pairs=part_pairs).collect()
    assert sorted(tuple(r) for r in got) == brute(docs, items, 7)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert balltree.ranked(docs, items).count() == 1
    assert balltree.ranked(docs.limit(0), items).count() == 0 and balltree.ranked(docs, items.limit(0)).count() == 0


def rows_of(r, n, width):
    parts = [np.sort(r.choice(width, r.randint(0, 9), replace=False)) for _ in range(n)]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    columns = np.concatenate(parts)
    return starts, columns, r.randint(1, 10**6, len(columns))


def test_bounds_hold():
    r = np.random.RandomState(6)
    width = 40
    for trial in range(20):
        starts, columns, values = rows_of(r, 300, width)
        if trial % 2:
            # Heavy and light documents.
            values = values // np.repeat(1 + 999 * (np.arange(300) % 2), np.diff(starts))
        scale = r.uniform(0.1, 5, width)
        order, tree = balltree.build_tree(starts, columns, values * scale[columns], width, leaf=8)
        terms = np.sort(r.choice(width, 5, replace=False))
        weights = np.zeros(width, np.int64)
        weights[terms] = r.randint(1, 20_000, 5)
        top = balltree.bounds(tree, terms, weights[terms] / scale[terms])
        scores = np.array([int((values[starts[i] : starts[i + 1]] * weights[columns[starts[i] : starts[i + 1]]]).sum()) for i in order])
        assert sorted(order) == list(range(300))
        for node, (a, b) in enumerate(tree.span):
            assert scores[a:b].max() <= top[node]


def test_unlike_documents_are_not_scored():
    r = np.random.RandomState(7)
    ids, width = np.arange(2000), 64
    # Rows of eight groups with terms of their own.
    parts = [np.sort(8 * (i % 8) + r.choice(8, 4, replace=False)) for i in ids]
    starts = np.arange(2001) * 4
    columns, values = np.concatenate(parts), r.randint(500, 1000, 8000)
    queries = balltree.Queries(np.array([1]), [np.arange(8)], np.full(width, 100), np.ones(width))
    search = balltree.Search(queries, 5)
    search.add(ids, starts, columns, values)
    assert search.scored <= 700 and len(search.best[0]) == 5
