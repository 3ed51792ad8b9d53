"""Quality model: its parts against plain numpy, and held-out accuracy on the small tables."""

import random

import numpy as np

from lodestone.llm import quality
from lodestone.llm.catalog import op12_quality


def test_features_approximate_a_gaussian_kernel():
    r = np.random.RandomState(1)
    x = r.standard_normal((60, quality.STATISTICS))
    kind = quality.Features(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS), 1.0)
    z = kind.of(x)
    square = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = np.exp(-square / (2 * quality.STATISTICS))
    assert np.abs(z @ z.T - want).max() < 5 / np.sqrt(quality.FEATURES)
    assert np.abs(z @ z.T - want).mean() < 1 / np.sqrt(quality.FEATURES)


def test_moments_over_partitions_equal_one_matrix(spark):
    r = np.random.RandomState(2)
    x, y = r.standard_normal((90, quality.STATISTICS)), r.randint(0, 2, 90)
    kinds = [quality.Features(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS), w) for w in (0.5, 2.0)]
    rows = [(x[i].tolist(), int(y[i]), i % quality.FOLDS) for i in range(90)]
    got = quality._moments(spark.createDataFrame(rows, "x array<double>, y int, fold int").repartition(7), kinds)
    for k, kind in enumerate(kinds):
        for f in range(quality.FOLDS):
            mine = np.arange(90) % quality.FOLDS == f
            z = np.column_stack([kind.of(x[mine]), np.ones(mine.sum()), y[mine]])
            assert np.allclose(got[k, f], z.T @ z)
    total = sum(got[0, f] for f in range(quality.FOLDS))
    w = quality.solve(total, 0.1)
    z = np.column_stack([kinds[0].of(x), np.ones(90)])
    stiff = np.diag([0.1 * 90] * quality.FEATURES + [1e-9])
    assert np.allclose(w, np.linalg.solve(z.T @ z + stiff, z.T @ y))
    assert np.isclose(quality.squared_error(total, w), ((z @ w - y) ** 2).sum())


def test_pooling_equals_the_max_min_form():
    r = random.Random(3)
    for _ in range(50):
        n = r.randrange(1, 12)
        rows = np.array([r.randrange(1, 5) for _ in range(n)], float)
        good = np.array([r.randrange(int(c) + 1) for c in rows], float)
        at, rate = quality.pooled(np.arange(n, dtype=float), rows, good)
        assert (np.diff(rate) >= 0).all() and (np.diff(at) > 0).all()
        # Isotonic fit at i: the largest over starts of the smallest mean up to some end.
        fit = [max(min(good[a : b + 1].sum() / rows[a : b + 1].sum() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert len(set(np.round(fit, 9))) == len(at)


def test_learned_model_tells_held_out_rows(spark):
    got = op12_quality(spark, "/root/testdata/sf0.01").toPandas()
    assert got.score.between(0, 1).all()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = got.merge(labels, on="doc_id")
    held = held[held.held_out & held.quality.notna()]
    assert len(held) > 50 and (held.predicted == held.quality).mean() >= 0.95


def test_odd_rows_and_labels(spark):
    docs = spark.createDataFrame(
        [(1, None, 1.0), (1, "", 1.0), (2, "a plain text. " * 3, 1.0), (2, "a plain text. " * 3, 1.0), (None, "x" * 200_000, 1.0), (3, "## !! ## " * 9, 0.0)],
        "doc_id long, text string, score double",
    )
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    flat = quality.scored(docs, quality.learn(docs, none)).collect()
    assert len(flat) == 6 and all(0.49 <= r.score <= 0.51 and r.predicted == 0 for r in flat)
    labels = spark.createDataFrame([(i, q, None) for i, q in [(1, 1), (2, 1), (2, 0), (3, 0), (None, 1), (7, None), (9, 3)]], "doc_id long, quality int, toxic int")
    rows = quality.scored(docs, quality.learn(docs, labels)).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert rows[0].score == rows[1].score and rows[2].score == rows[3].score
    assert quality.scored(docs.limit(0), quality.learn(docs.limit(0), labels)).count() == 0
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
