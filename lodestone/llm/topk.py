"""Exact top-k search by distributed histogram selection.

Queries and candidates meet in cells of bounded blocks.  Each pass scores every cell and counts the
scores in a histogram per query; the global histogram tells the bin that holds the k-th score, and
the next pass refines that bin until it is one score wide.  A last pass keeps what lies above and
breaks ties by id.  A cell never counts below its own k-th score, since the global one is no lower,
so a query sends about k numbers per cell and pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import arrays
from lodestone.operators.ranking import top_k
from lodestone.session import checkpoint

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
_BINS = 256
# Products of float64 sums are exact up to here.
_EXACT = 1 << 53


def integer_vectors(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """``(vec_id, v)``: components as ``floor(scale * x)`` in double precision.

    Vectors that are null or hold a null or non-finite component go, as do rows without an id.
    Rows that repeat an id are one vector, the smallest of them in array order.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (
        embeddings.where("embedding is not null and vec_id is not null")
        .select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(~F.coalesce(bad, F.lit(False)))
        .select("vec_id", F.transform("x", lambda c: F.floor(c * float(scale)).cast("long")).alias("v"))
        .groupBy("vec_id").agg(F.min("v").alias("v"))
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = arrays(column)
    return np.array(rows, dtype=np.int64).reshape(len(rows), -1)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if bound < 1 << 24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < _EXACT:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _cell(work: Callable) -> Callable:
    """Run ``work(query table, ids, scores, own)`` on a cell's tables."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "x": pa.array([], pa.int64()), "y": pa.array([], pa.int64())})
        qid, cid = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        order = np.argsort(cid, kind="stable")
        cid = cid[order]
        scores = _scores(_matrix(left.column("v")), _matrix(right.column("v"))[order])
        query, x, y = work(left, qid, cid, scores)
        return pa.table({"query_id": pa.array(qid[query]), "x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    return run


def _others(qid: np.ndarray, cid: np.ndarray, i: int) -> np.ndarray:
    """Candidates of query ``i``: all but itself."""
    return cid != qid[i]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best candidates of each query, fewer if there are fewer.

    ``vectors`` and ``queries`` hold ``(vec_id long, v array<long>)`` with distinct ids; a query is
    no candidate of its own, and meets vectors of its own length only.  The score is the inner
    product, ties go to the smaller id.  Scores must fit 64 bits.
    """
    counted = vectors.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))))
    n, longest = counted.first()
    n_queries = queries.count()
    q_blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))
    c_blocks = max(1, math.ceil(n / CANDIDATE_BLOCK))

    def block(blocks: int):
        return F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")

    reach = F.ceil(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)) * float(longest or 0) * (1 + 1e-9) + 1)
    # The k-th score lies in low .. low + width - 1; above counts the scores beyond.
    start = queries.withColumn("low", (-reach).cast("long")).withColumn("width", (2 * reach + 1).cast("long")).withColumn(
        "above", F.lit(0).cast("long")
    )
    candidates = checkpoint(
        vectors.withColumn("dim", F.size("v")).withColumn("cb", block(c_blocks))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    )

    def cells(state: DataFrame, work: Callable, schema: str) -> DataFrame:
        spread = state.withColumn("dim", F.size("v")).withColumn("qb", block(q_blocks)).withColumn(
            "cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))
        )
        keys = ("dim", "qb", "cb")
        return spread.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(_cell(work), schema)

    def count(left: pa.Table, qid: np.ndarray, cid: np.ndarray, scores: np.ndarray):
        low, width = left.column("low").to_numpy(), left.column("width").to_numpy()
        above = left.column("above").to_numpy()
        out = []
        for i in range(len(qid)):
            s = scores[i][_others(qid, cid, i)]
            need = k - above[i]
            step = -(-width[i] // _BINS)
            inside = s[(s >= low[i]) & (s < low[i] + width[i])]
            if len(inside) > need:
                inside = inside[inside >= np.partition(inside, len(inside) - need)[len(inside) - need]]
            bins, counts = np.unique((inside - low[i]) // step, return_counts=True)
            out.append((np.full(len(bins), i), bins, counts))
        return tuple(np.concatenate(p).astype(np.int64) for p in zip(*out, strict=True))

    state = checkpoint(start)
    while True:
        left = state.where("width > 1").agg(F.count("*")).first()[0]
        if not left:
            break
        histogram = cells(state.where("width > 1"), count, "query_id long, x long, y long").groupBy("query_id", "x").agg(
            F.sum("y").alias("n")
        )
        down = Window.partitionBy("query_id").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
        reached = histogram.withColumn("run", F.sum("n").over(down)).join(
            state.select(F.col("vec_id").alias("query_id"), "above"), "query_id"
        ).where(F.col("above") + F.col("run") >= k)
        held = reached.groupBy("query_id").agg(F.max(F.struct("x", "run", "n")).alias("b")).select(
            F.col("query_id").alias("qid"), F.col("b.x").alias("bin"), (F.col("b.run") - F.col("b.n")).alias("more")
        )
        step = F.ceil(F.col("width") / _BINS)
        narrowed = state.join(held, F.col("vec_id") == F.col("qid"), "left").select(
            "vec_id", "v",
            F.when(F.col("width") == 1, F.col("low")).when(F.col("bin").isNull(), F.col("low"))
            .otherwise(F.col("low") + F.col("bin") * step).alias("low"),
            # Fewer than k candidates in all: everything from the lowest score on is kept.
            F.when((F.col("width") == 1) | F.col("bin").isNull(), F.lit(1)).otherwise(step).cast("long").alias("width"),
            (F.col("above") + F.coalesce("more", F.lit(0))).alias("above"),
        )
        state = checkpoint(narrowed)

    def keep(left: pa.Table, qid: np.ndarray, cid: np.ndarray, scores: np.ndarray):
        low, above = left.column("low").to_numpy(), left.column("above").to_numpy()
        out = []
        for i in range(len(qid)):
            others = _others(qid, cid, i)
            s, ids = scores[i][others], cid[others]
            better = np.flatnonzero(s > low[i])
            # Ids ascend, so of equal scores the first are the smallest.
            ties = np.flatnonzero(s == low[i])[: max(0, k - above[i])]
            at = np.concatenate([better, ties])
            out.append((np.full(len(at), i), ids[at], s[at]))
        return tuple(np.concatenate(p).astype(np.int64) for p in zip(*out, strict=True))

    kept = cells(state, keep, "query_id long, x long, y long").select(
        "query_id", F.col("x").alias("vec_id"), F.col("y").alias("score")
    )
    best = top_k(kept, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
