"""Similarity joins of a set of vectors with itself, in cells around pivots.

Every vector is *at home* in the cell of its nearest pivot.  A vector that may
be a partner of someone at home in another cell also *visits* that cell: by the
triangle inequality two unit vectors within distance ``eps`` can only meet in
the home of the one if the other lies within ``2 * eps`` of its own home
distance from that cell's pivot (the ClusterJoin scheme of Das Sarma et al.,
VLDB 2014).  The join is exact, and each target finds all its partners in one
cell.

Cells may be of any size: each is cut into blocks by a hash of the ids, and a
task holds one block of targets and one of visitors.  Kernels return at most a
few rows per target and block, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.blocks import int64, matrix, similarity_slices, unit_rows
from lodestone.session import checkpoint, spread_small_scan

_MAX_PIVOTS = 2048
_CELL_ROWS = 16384
_BLOCK = 8192
# Allowance for rounding in the distances that prune.
_SLACK = 1e-6

# A kernel sees target ids, visitor ids, the visitors' flags, and slices
# (start, sims) of the similarity matrix; it returns the output columns.
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, Iterator], dict]


@dataclass(frozen=True)
class Placement:
    """Vectors with their cells, and the number of blocks each cell is cut into.

    ``rows`` is the input plus ``home int`` and ``visits array<int>``; ``cells`` is
    ``(cell, t_blocks, v_blocks)``, at most one row per pivot.
    """

    rows: DataFrame
    cells: DataFrame


_CELLS = "cell int, t_blocks long, v_blocks long"


def place(vectors: DataFrame, threshold: float) -> Placement:
    """Assign ``(id, vec, ...)`` to cells such that partners of cosine >= threshold meet.

    The rows are checkpointed: pivots are drawn once and all rounds share them.
    """
    spark = vectors.sparkSession
    vectors = checkpoint(spread_small_scan(vectors, "id"))
    n = vectors.count()
    n_pivots = min(_MAX_PIVOTS, n // _CELL_ROWS) if threshold > 0 else 0
    if n_pivots < 2:
        blocks = max(1, -(-n // _BLOCK))
        one = vectors.withColumn("home", F.lit(0)).withColumn("visits", F.array(F.lit(0)))
        return Placement(one, spark.createDataFrame([(0, blocks, blocks)], _CELLS))
    drawn = vectors.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(n_pivots).toArrow()
    held = vectors.sparkSession.sparkContext.broadcast(unit_rows(matrix(drawn["vec"])))
    eps = math.sqrt(max(0.0, 2.0 - 2.0 * threshold))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = unit_rows(matrix(batch.column("vec")))
            home = np.zeros(len(unit), np.int32)
            visits = []
            for start, sims in similarity_slices(unit, pivots):
                # A zero vector is at distance 1 from every pivot and has no partners.
                lengths = np.linalg.norm(unit[start : start + len(sims)], axis=1, keepdims=True)
                dist = np.sqrt(np.maximum(0.0, lengths**2 + 1.0 - 2.0 * sims))
                nearest = dist.argmin(axis=1)
                home[start : start + len(sims)] = nearest
                reach = dist[np.arange(len(sims)), nearest] + 2 * eps + _SLACK
                visits.extend(np.flatnonzero(d <= r).astype(np.int32) for d, r in zip(dist, reach))
            out = batch.append_column("home", pa.array(home, pa.int32()))
            yield out.append_column("visits", pa.array(visits, pa.list_(pa.int32())))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    rows = checkpoint(vectors.mapInArrow(assign, f"{fields}, home int, visits array<int>"))
    at_home = rows.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("t"))
    visiting = rows.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("v"))
    counted = [
        (r.cell, -(-r.t // _BLOCK), -(-r.v // _BLOCK)) for r in at_home.join(visiting, "cell").collect()
    ]
    return Placement(rows, spark.createDataFrame(counted, _CELLS))


def block_join(
    targets: DataFrame,
    visitors: DataFrame,
    cells: DataFrame,
    kernel: Kernel,
    schema: str,
    flag: str | None = None,
) -> DataFrame:
    """Run ``kernel`` on every block of targets ``(id, vec, home)`` with every block of visitors
    ``(id, vec, visits)`` of the same cell.  ``flag`` names an integer column of the visitors
    handed to the kernel.
    """
    mark = F.col(flag).cast("long") if flag else F.lit(0).cast("long")
    # The two sides may come from one relation; new names keep their columns apart.
    visiting = visitors.select(
        F.col("id").alias("v_id"), F.col("vec").alias("v_vec"), mark.alias("mark"),
        F.explode("visits").alias("cell"),
    )
    staying = targets.select("id", "vec", F.col("home").alias("cell"))
    # One row per pivot at most, so the broadcast is bounded.
    cells = F.broadcast(cells)
    left = staying.join(cells, "cell").select(
        "id", "vec", "cell",
        F.pmod(F.xxhash64("id"), F.col("t_blocks")).alias("tb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("v_blocks") - 1)).alias("vb"),
    )
    right = visiting.join(cells, "cell").select(
        "v_id", "v_vec", "mark", "cell",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("t_blocks") - 1)).alias("tb"),
        F.pmod(F.xxhash64("v_id"), F.col("v_blocks")).alias("vb"),
    )

    def meet(t: pa.Table, v: pa.Table) -> pa.Table:
        t_ids, v_ids = int64(t["id"]), int64(v["v_id"])
        left_m, right_m = unit_rows(matrix(t["vec"])), unit_rows(matrix(v["v_vec"]))
        slices = similarity_slices(left_m, right_m) if len(t_ids) and len(v_ids) else iter(())
        return pa.table(kernel(t_ids, v_ids, int64(v["mark"]), slices))

    keys = ["cell", "tb", "vb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)
