"""Exact k nearest neighbours by cosine for a batch of query vectors.

No pair of vectors ever becomes a row: blocks are multiplied inside a task and
only the best ``k`` per query and block leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vectors import similarity_from_cosine
from lodestone.operators.blocks import best_of, int64, matrix, similarity_slices, unit_rows
from lodestone.operators.ranking import top_k
from lodestone.session import BROADCAST_BYTES, measured_bytes, spread_small_scan

_SCHEMA = "qid long, id long, cos double"
# Rows of either side that meet in one task when the queries are not broadcast.
_BLOCK = 16384


def _best_pairs(qids, q, ids, c, k: int, min_cos: float | None) -> pa.Table:
    out_q, out_id, out_cos = [], [], []
    if len(q) and len(c):
        for start, sims in similarity_slices(q, c):
            for row, scores in enumerate(sims):
                best, values = best_of(scores, ids, k)
                if min_cos is not None:
                    best, values = best[values >= min_cos], values[values >= min_cos]
                out_q.append(np.full(len(best), qids[start + row]))
                out_id.append(ids[best])
                out_cos.append(values)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.table(
        {"qid": join(out_q, np.int64), "id": join(out_id, np.int64), "cos": join(out_cos, np.float64)}
    )


def _broadcast_knn(corpus: DataFrame, queries: DataFrame, k: int, min_cos: float | None) -> DataFrame:
    """Corpus stays where it is; the measured-small query matrix goes to every task."""
    table = queries.toArrow()
    held = corpus.sparkSession.sparkContext.broadcast(
        (int64(table["qid"]), unit_rows(matrix(table["vec"])))
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = held.value
        for batch in batches:
            if batch.num_rows:
                c = unit_rows(matrix(batch.column(1)))
                best = _best_pairs(qids, q, int64(batch.column(0)), c, k, min_cos)
                yield from best.to_batches()

    return corpus.mapInArrow(scan, _SCHEMA)


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _grid_knn(corpus: DataFrame, queries: DataFrame, k: int, min_cos: float | None) -> DataFrame:
    """Both sides large: every pair of a query block and a corpus block meets in one task.

    Blocks are cut by a hash of unique ids, so each holds about the same number
    of rows whatever the vectors look like.
    """
    n_q = max(1, -(-queries.count() // _BLOCK))
    n_c = max(1, -(-corpus.count() // _BLOCK))
    left = queries.select(
        "qid", "vec",
        F.pmod(F.xxhash64("qid"), _long(n_q)).alias("qb"),
        F.explode(F.sequence(_long(0), _long(n_c - 1))).alias("cb"),
    )
    right = corpus.select(
        "id", F.col("vec").alias("c_vec"),
        F.explode(F.sequence(_long(0), _long(n_q - 1))).alias("qb"),
        F.pmod(F.xxhash64("id"), _long(n_c)).alias("cb"),
    )

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        return _best_pairs(
            int64(q["qid"]), unit_rows(matrix(q["vec"])),
            int64(c["id"]), unit_rows(matrix(c["c_vec"])), k, min_cos,
        )

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(meet, _SCHEMA)


def knn_search(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    min_cos: float | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(qid, rank, id, cos)`` for a corpus ``(id, vec)`` and queries ``(qid, vec)``.

    ``min_cos`` drops hits below it (inclusive bound).  Ties go to the lower id.
    """
    corpus = spread_small_scan(corpus.select("id", "vec"), "id")
    queries = queries.select("qid", "vec")
    width = 8 * F.size("vec")
    if measured_bytes(queries, per_row=8, payload=width) <= broadcast_bytes:
        pairs = _broadcast_knn(corpus, queries, k, min_cos)
    else:
        pairs = _grid_knn(corpus, queries, k, min_cos)
    best = top_k(pairs, ["qid"], [F.desc("cos"), F.asc("id")], k)
    return best.select("qid", "rank", "id", "cos")


def vector_search(chunks: DataFrame, queries: DataFrame, k: int, cutoff: float) -> DataFrame:
    """``(qid, rank, id, sim)`` with ``sim = 1 - d / 2`` of the cosine distance ``d``.

    The cutoff is inclusive and applies after the cut to ``k``; since it grows
    with the cosine it can only shorten the tail of the ranking.
    """
    hits = knn_search(chunks, queries, k)
    sim = similarity_from_cosine(F.col("cos"))
    return hits.withColumn("sim", sim).where(F.col("sim") >= cutoff).select("qid", "rank", "id", "sim")
