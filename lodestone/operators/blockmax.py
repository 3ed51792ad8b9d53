"""Weighted sums over sparse document vectors, the best few per query, with exact block skipping.

A task takes documents block by block and inverts each block into postings.  The largest value of a
term in a block bounds what the block can add to any query; a query looks into a block only if the
sum of its bounds reaches its k-th score so far (MaxScore over block maxima).  What leaves a task is
``k`` rows per query, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Documents of one block.
BLOCK = 1024
# Wider than what rounding can move a bound below the sum it bounds.
_SLACK = 1e-9


@dataclass(frozen=True)
class Weights:
    """Sparse queries: ``terms[i]`` and ``gains[i]`` belong to ``qids[i]``; gains are not negative."""

    qids: np.ndarray
    terms: list[np.ndarray]
    gains: list[np.ndarray]
    n_terms: int

    @staticmethod
    def of(qid: np.ndarray, term: np.ndarray, gain: np.ndarray, n_terms: int) -> Weights:
        order = np.lexsort((term, qid))
        qids, begins = np.unique(qid[order], return_index=True)
        return Weights(qids, np.split(term[order], begins[1:]), np.split(gain[order], begins[1:]), n_terms)


class Best:
    """The best ``k`` documents per query so far, by score rounded to ``digits``, then by id."""

    def __init__(self, queries: int, k: int, digits: int) -> None:
        self.k, self.digits = k, digits
        self.scores: list[np.ndarray] = [np.zeros(0)] * queries
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * queries

    def bar(self, q: int) -> float:
        """What a document has to reach; nothing while there are fewer than ``k``."""
        return self.scores[q][-1] if len(self.scores[q]) == self.k else -np.inf

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        order = np.lexsort((ids, -np.round(scores, self.digits)))[: self.k]
        self.ids[q], self.scores[q] = ids[order], scores[order]


def search_block(best: Best, weights: Weights, ids: np.ndarray, starts: np.ndarray, terms: np.ndarray, values: np.ndarray) -> int:
    """Take one block of documents into ``best``; tells how many queries looked into it."""
    order = np.argsort(terms, kind="stable")
    docs = np.repeat(np.arange(len(ids)), np.diff(starts))[order]
    held, values = terms[order], values[order]
    at = np.searchsorted(held, np.arange(weights.n_terms + 1))
    top = np.zeros(weights.n_terms)
    np.maximum.at(top, held, values)
    looked = 0
    for q, (mine, gains) in enumerate(zip(weights.terms, weights.gains, strict=True)):
        bound = float(gains @ top[mine])
        if bound <= 0 or bound * (1 + _SLACK) + _SLACK < best.bar(q):
            continue
        looked += 1
        sizes = at[mine + 1] - at[mine]
        ends = np.cumsum(sizes)
        place = np.repeat(at[mine] - (ends - sizes), sizes) + np.arange(ends[-1])
        scores = np.bincount(docs[place], np.repeat(gains, sizes) * values[place], minlength=len(ids))
        found = np.unique(docs[place])
        found = found[scores[found] * (1 + _SLACK) + _SLACK >= best.bar(q)]
        best.add(q, ids[found], scores[found])
    return looked


def top_sums(
    documents: DataFrame, weights: Weights, value: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, digits: int
) -> DataFrame:
    """``(qid, doc_id, score)`` of ``(doc_id, dl, terms array<int>, tf array<long>)``, ``k`` rows per query and task.

    ``value(tf, dl)`` is what a term adds per unit of gain; it is not negative.  The weights must be
    of a measured size, as every task holds them.
    """
    # Plain values: a broadcast is unpickled where this package need not be installed.
    held = documents.sparkSession.sparkContext.broadcast((weights.qids, weights.terms, weights.gains, weights.n_terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(*held.value)
        best = Best(len(weights.qids), k, digits)
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                ids, dl = part.column(0).to_numpy(), part.column(1).to_numpy()
                starts = part.column(2).offsets.to_numpy().astype(np.int64)
                starts = starts - starts[0]
                tf = part.column(3).flatten().to_numpy().astype(np.float64)
                values = value(tf, np.repeat(dl, np.diff(starts)).astype(np.float64))
                search_block(best, weights, ids, starts, part.column(2).flatten().to_numpy(), values)
        counts = [len(i) for i in best.ids]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(weights.qids, counts), pa.int64()),
                pa.array(np.concatenate(best.ids) if counts else [], pa.int64()),
                pa.array(np.concatenate(best.scores) if counts else [], pa.float64()),
            ],
            ["qid", "doc_id", "score"],
        )

    return documents.select("doc_id", "dl", "terms", "tf").mapInArrow(run, "qid long, doc_id long, score double")
