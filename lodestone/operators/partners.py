"""Bounded lists of earlier partners: the sparse graph on which sequential rules are decided.

One similarity join gives every row the first few of its earlier partners, by age or by similarity,
and tells whether there are more.  Rules are then decided over these lists of ids; no vector is
touched again, but for rows whose list is used up while partners beyond it may matter.  A crowded
group of ``n`` rows makes ``n`` short lists, not ``n * n`` pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.blocks import near_pairs
from lodestone.operators.ranking import top_k
from lodestone.operators.simjoin import Placement, block_join

OPEN, KEPT, DROPPED, USED_UP = 0, 1, 2, 3
# Partners a list holds at least.
WIDTH = 32
_PAIRS = "id long, cand long, sim double"


def _first(limit: int, gate: float, strict: bool, nearest: bool):
    def kernel(t_ids, v_ids, marks, slices):
        ids, cands, sims_out = [], [], []
        for start, sims in slices:
            rows, cols, values = near_pairs(sims, gate)
            fits = ((values > gate) if strict else (values >= gate)) & (v_ids[cols] < t_ids[start + rows])
            rows, cand, values = rows[fits], v_ids[cols[fits]], values[fits]
            order = np.lexsort((cand, -values, rows) if nearest else (cand, rows))
            rows, cand, values = rows[order], cand[order], values[order]
            begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])[: len(rows)])
            place = np.arange(len(rows)) - np.repeat(begin, np.diff(np.append(begin, len(rows))))
            first = place < limit
            ids.append(t_ids[start + rows[first]])
            cands.append(cand[first])
            sims_out.append(values[first])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return {"id": join(ids, np.int64), "cand": join(cands, np.int64), "sim": join(sims_out, np.float64)}

    return kernel


def partner_lists(
    placed: Placement, targets: DataFrame, visitors: DataFrame, gate: float, width: int, strict: bool = False, nearest: bool = False
) -> DataFrame:
    """``(id, cands, more)`` for targets with earlier partners among the visitors.

    ``cands`` are the first ``width`` of them as ``(rank, cand, sim)``, oldest or nearest first; ``more``
    tells that there are others.  Both sides are rows of ``placed``.  ``strict`` leaves out partners at
    the gate itself.

    Of visitors with one and the same vector, only the first can be listed: all are as near to a target,
    and the younger come later in either order.
    """
    visitors = top_k(visitors, ["vec"], [F.asc("id")], width + 1, rank="copy").drop("copy")
    pairs = block_join(targets, visitors, placed.cells, _first(width + 1, gate, strict, nearest), _PAIRS)
    order = [F.desc("sim"), F.asc("cand")] if nearest else [F.asc("cand")]
    # A target meets several blocks of visitors, each of which offers its first.
    best = top_k(pairs, ["id"], order, width + 1)
    listed = best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "cand", "sim"))).alias("cands"))
    return listed.select("id", F.slice("cands", 1, width).alias("cands"), (F.size("cands") > width).alias("more"))
