"""Quality scores: a Gaussian kernel over document statistics, by random Fourier features.

* **Statistics.** Lengths, words, characters, lines and repetition of a whole text, as numbers that
  hardly depend on the language.
* **Features.** Random Fourier features of the standardised statistics; their inner products
  approximate a Gaussian kernel.  Directions are drawn from a fixed seed.
* **Ridge.** Every partition sums its part of the normal equations, per fold and width of the
  kernel; sums of a fixed size reach the driver.  Width and penalty are those of the least
  cross-validated squared error, which follows from the sums alone.
* **Isotonic calibration.** Rows are scored by the equations of the other folds; the share of good
  rows by score, made monotone by pooling neighbours, turns a ridge score into a probability.

Texts are scored by one column expression, so scoring needs no shuffle.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrays, lists, maybe_in, per_batch, utf8
from lodestone.llm.toxicity import held_out
from lodestone.session import checkpoint

# Labelled rows a model is fitted on, in expectation; drawn by a hash of the id.
TRAINING_ROWS = 50_000
FEATURES, SEED, FOLDS = 256, 7, 5
# Widths of the kernel, in typical distances of two documents, and penalties a row.
_WIDTHS = (0.5, 1.0, 2.0)
_PENALTIES = tuple(10.0**e for e in range(-7, 1))
# Rows of a matrix that are summed together.
_BLOCK = 43
# Bins of ridge scores within [-1, 2].
_BINS = 3000


def _kinds() -> np.ndarray:
    """Kind of every byte: lower, upper, digit, blank, stop, other mark, other control, beyond ASCII."""
    kinds = np.full(256, 6)
    kinds[33:127] = 5
    kinds[128:] = 7
    for kind, letters in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\f\v", b".,;:!?'\"-")):
        kinds[list(letters)] = kind
    return kinds


_KINDS = _kinds()
_ENDS = (b".", b"!", b"?", b'"', b"\xe2\x80\x9d", b"\xc2\xbb")
_LETTER = bytes(1 if k in (0, 1, 7) else 0 for k in _KINDS.tolist())


def statistics(text: bytes | None) -> list[float]:
    """Numbers that describe a whole text; an empty or null one has zeros only."""
    if not text:
        return [0.0] * STATISTICS
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(raw, minlength=256)
    n = len(raw)
    share = np.bincount(_KINDS, counts, minlength=8) / n
    seen = counts[counts > 0] / n
    letters = max(share[0] + share[1], 1e-9)
    words = text.split()
    many = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    times = Counter(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    rows = Counter(lines)
    repeated = sum(len(line) * (c - 1) for line, c in rows.items())
    triples = max(1, len(words) - 2)
    return [
        math.log1p(n), math.log1p(len(words)), float(sizes.mean()) if words else 0.0, float(sizes.std()), float(sizes.max()) ** 0.5,
        len(times) / many, math.log1p(len(times)) / math.log1p(many + 1), max(times.values(), default=0) / many,
        float(share[1] / letters), *map(float, share[[1, 2, 3, 4, 5, 6, 7]]), float(-(seen * np.log2(seen)).sum()),
        float((raw[1:] == raw[:-1]).mean()) if n > 1 else 0.0, len(zlib.compress(text, 1)) / n,
        math.log1p(len(lines)), math.log1p(n / max(1, len(lines))), 1 - len(rows) / max(1, len(lines)), repeated / n,
        sum(line.rstrip().endswith(_ENDS) for line in lines) / max(1, len(lines)),
        sum(c for w, c in times.items() if 1 not in w.translate(_LETTER)) / many,
        sum(c for w, c in times.items() if len(w) <= 3) / many, sum(c for w, c in times.items() if w.isupper() and len(w) > 1) / many,
        len(set(zip(words, words[1:], words[2:], strict=False))) / triples, math.log1p(many / max(1, sum(map(text.count, (b".", b"!", b"?"))))),
    ]


STATISTICS = 29


@dataclass
class Features:
    """Random Fourier features of statistics, for one width of the kernel."""

    mean: np.ndarray
    spread: np.ndarray
    width: float

    def of(self, x: np.ndarray) -> np.ndarray:
        r = np.random.RandomState(SEED)
        directions = r.standard_normal((x.shape[1], FEATURES)) / (self.width * math.sqrt(x.shape[1]))
        phases = r.uniform(0, 2 * math.pi, FEATURES)
        # Far outliers are as odd as odd ones.
        z = np.clip((x - self.mean) / self.spread, -6.0, 6.0)
        return math.sqrt(2 / FEATURES) * np.cos(z @ directions + phases)


@dataclass
class Model:
    """Ridge weights over features (the last one is the constant) and the steps of the calibration."""

    features: Features
    weights: np.ndarray
    at: np.ndarray
    rate: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features.of(x) @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; a small share of the raw score keeps the order of rows on one step."""
        raw = self.raw(x)
        return 0.99 * np.interp(raw, self.at, self.rate) + 0.01 / (1 + np.exp(-4 * (raw - 0.5)))

    def column(self, text: str | Column) -> Column:
        """The score of a text column; null reads as empty."""
        model = self

        @F.pandas_udf("double")
        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in parts:
                x = np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, STATISTICS)
                yield pd.Series(model.score(x))

        return score(utf8(text))


def solve(moments: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge weights from the moments of (features, 1, label); the constant is not penalised."""
    size = len(moments) - 1
    stiff = np.full(size, penalty * max(1.0, moments[-2, -2]))
    stiff[-1] = 1e-9
    return np.linalg.solve(moments[:-1, :-1] + np.diag(stiff), moments[:-1, -1])


def squared_error(moments: np.ndarray, weights: np.ndarray) -> float:
    """Summed squared error of ``weights`` on the rows the moments stand for."""
    full = np.append(weights, -1.0)
    return float(full @ moments @ full)


def pooled(score: np.ndarray, rows: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: centres of the steps and their shares of good rows.

    ``score`` ascends.  Shares lean a little to the overall share, so that few rows are never certain.
    """
    base = (good.sum() + 0.5) / (rows.sum() + 1.0)
    blocks: list[list[float]] = []
    for s, n, g in zip(score, rows, good, strict=True):
        blocks.append([s * n, n, g])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    at = np.array([b[0] / b[1] for b in blocks])
    rate = np.array([(b[2] + base) / (b[1] + 1.0) for b in blocks])
    return at, np.maximum.accumulate(rate)


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``(x, y, fold)``: statistics of labelled texts, each distinct text once."""
    usable = (
        labels.where("doc_id is not null and quality in (0, 1)").where(~held_out("doc_id"))
        .groupBy(F.col("doc_id").cast("long").alias("__labelled")).agg(F.max("quality").cast("int").alias("__quality"))
    )
    share = min(1.0, rows / max(1, usable.count()))
    drawn = usable.where(F.pmod(F.xxhash64("__labelled"), F.lit(1_000_000)) < int(share * 1_000_000))
    # Texts stay where they are: only statistics and a digest travel.
    labelled = maybe_in(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(utf8("text"), F.lit(b"")).alias("text")),
        F.col("doc_id"), drawn, F.col("__labelled"),
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), lists([np.array(statistics(t)) for t in texts], pa.float64()),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
            ],
            ["doc_id", "x", "digest"],
        )

    rows = per_batch(labelled, work, "doc_id long, x array<double>, digest binary")
    known = rows.join(drawn, F.col("doc_id") == F.col("__labelled")).groupBy("digest")
    fold = F.pmod(F.xxhash64("digest"), F.lit(FOLDS)).cast("int")
    return checkpoint(known.agg(F.max("x").alias("x"), F.max("__quality").alias("y")).select("x", "y", fold.alias("fold")))


def _moments(sample: DataFrame, kinds: list[Features]) -> dict[tuple[int, int], np.ndarray]:
    """Moments of (features, 1, label) by kind and fold, summed over partitions."""
    size = FEATURES + 2

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(kinds), FOLDS, size, size))
        for batch in batches:
            x = np.array(arrays(batch.column(0))).reshape(-1, STATISTICS)
            y, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k, kind in enumerate(kinds):
                z = np.column_stack([kind.of(x), np.ones(len(x)), y])
                for f in range(FOLDS):
                    part = z[fold == f]
                    sums[k, f] += part.T @ part
        keys = [(k, f, i) for k in range(len(kinds)) for f in range(FOLDS) for i in range(0, size, _BLOCK)]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([key[c] for key in keys], pa.int32()) for c in range(3)), lists([sums[k, f, i : i + _BLOCK].ravel() for k, f, i in keys], pa.float64())],
            ["kind", "fold", "i", "part"],
        )

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.sum(arrays(table.column("part")), axis=0)
        return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [lists([total], pa.float64())], ["kind", "fold", "i", "part"])

    schema = "kind int, fold int, i int, part array<double>"
    parts = sample.mapInArrow(work, schema).groupBy("kind", "fold", "i").applyInArrow(add, schema).collect()  # of a fixed size
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in parts:
        out.setdefault((r["kind"], r["fold"]), np.zeros((size, size)))[r["i"] : r["i"] + _BLOCK] = np.reshape(r["part"], (-1, size))
    return out


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``.

    Only rows that are not held out, with a label 0 or 1, are used; of conflicting labels of one id the
    larger counts, as it does for equal texts; null texts read as empty.  Without usable rows every text
    scores 0.5, with labels of one kind near that kind.
    """
    sample = _sample(docs, labels, rows)
    spread = [f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(STATISTICS)]
    found = sample.agg(F.count("*"), *spread).first()
    if not found[0]:
        none = Features(np.zeros(STATISTICS), np.ones(STATISTICS), 1.0)
        return Model(none, np.append(np.zeros(FEATURES), 0.5), np.array([0.5]), np.array([0.5]))
    mean, deviation = np.array(found[1:]).reshape(2, -1)
    deviation = np.where(deviation > 1e-9, deviation, 1.0)
    kinds = [Features(mean, deviation, w) for w in _WIDTHS]
    moments = _moments(sample, kinds)
    best: tuple[float, int, float] | None = None
    for k in range(len(kinds)):
        total = sum(moments[k, f] for f in range(FOLDS))
        for penalty in _PENALTIES:
            error = sum(squared_error(moments[k, f], solve(total - moments[k, f], penalty)) for f in range(FOLDS))
            if best is None or error < best[0]:
                best = (error, k, penalty)
    _, k, penalty = best
    total = sum(moments[k, f] for f in range(FOLDS))
    others = [solve(total - moments[k, f], penalty) for f in range(FOLDS)]
    kind = kinds[k]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(arrays(batch.column(0))).reshape(-1, STATISTICS)
            w = np.array(others)[batch.column(2).to_numpy()]
            raw = (kind.of(x) * w[:, :-1]).sum(axis=1) + w[:, -1]
            bins = np.clip(np.floor((raw + 1) * (_BINS / 3)), 0, _BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], ["bin", "y"])

    binned = sample.mapInArrow(work, "bin long, y int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("good"))
    steps = sorted(tuple(r) for r in binned.collect())  # a row a bin at most
    centre, n, good = (np.array(c, float) for c in zip(*steps, strict=True))
    at, rate = pooled((centre + 0.5) * (3 / _BINS) - 1, n, good)
    return Model(kind, solve(total, penalty), at, rate)


def scored(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row; other columns are ignored, null texts read as empty."""
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), model.column("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
