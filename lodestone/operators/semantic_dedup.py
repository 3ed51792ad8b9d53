"""Greedy removal of near copies: in ledger order, a row goes if an earlier *kept* row is too similar.

One similarity join lists the oldest earlier partners of every row.  The outcome of the sequential
rule is then reached in rounds over these lists: a row falls if a partner was kept, and is kept once
all its partners have fallen.  A row that is dropped never suppresses another one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vectors import l2_norm
from lodestone.operators.partners import DROPPED, KEPT, OPEN, USED_UP, WIDTH, partner_lists
from lodestone.operators.simjoin import place
from lodestone.session import checkpoint, checkpoint_counting

def _step(open_rows: DataFrame, decided: DataFrame) -> DataFrame:
    """``(id, state, cands, more)`` of open rows, given what was decided since their lists were cut last."""
    fate = decided.select(F.col("id").alias("cand"), F.col("state").alias("fate"))
    met = open_rows.select("id", "more", F.explode("cands").alias("cand")).join(fate, "cand", "left")
    left = met.groupBy("id").agg(
        F.max(F.coalesce(F.col("fate") == KEPT, F.lit(False))).alias("near_kept"),
        F.collect_list(F.when(F.col("fate").isNull(), F.col("cand"))).alias("cands"), F.max("more").alias("more"),
    )
    state = (
        F.when(F.col("near_kept"), DROPPED).when(F.size("cands") > 0, OPEN).when(F.col("more"), USED_UP).otherwise(KEPT)
    )
    return left.select("id", state.alias("state"), "cands", "more")


def semantic_dedup(vectors: DataFrame, threshold: float, width: int = WIDTH, strict: bool = True) -> DataFrame:
    """``(id, kept)`` for ``(id, embedding)``; the id is the ledger position.

    An optional boolean column ``settled`` marks rows kept by an earlier run, which must precede all
    others; they are not judged again.  Lists hold ``width`` partners; only a row with more partners,
    all of whose listed ones have fallen, is joined once more, against rows that have not fallen.
    The number of rounds is the longest chain of dependent rows.  Without ``strict`` a similarity
    of the threshold itself is too much.
    """
    if "settled" not in vectors.columns:
        vectors = vectors.withColumn("settled", F.lit(False))
    rows = vectors.select("id", F.col("embedding").alias("vec"), "settled")
    if 0.0 <= threshold < 1.0:
        # Exact copies of a vector share the fate of the first: it is their
        # partner if kept, and whoever drops it drops them too.  Zero vectors
        # are similar to nothing and all stay.
        zero = rows.where(l2_norm(F.col("vec")) == 0.0).select("id")
        leaders = (
            rows.where(l2_norm(F.col("vec")) != 0.0)
            .groupBy("vec")
            .agg(F.min("id").alias("id"), F.max("settled").alias("settled"))
        )
    else:
        zero, leaders = None, rows
    placed = place(leaders, threshold)
    fresh = placed.rows.where(~F.col("settled"))

    def listed(targets: DataFrame, visitors: DataFrame) -> DataFrame:
        found = partner_lists(placed, targets, visitors, threshold, width, strict=strict)
        return found.select("id", F.lit(OPEN).alias("state"), F.col("cands.cand").alias("cands"), "more")

    waiting = checkpoint(listed(fresh, placed.rows))
    news = checkpoint(placed.rows.join(waiting, "id", "left_anti").select("id", F.lit(KEPT).alias("state")))
    outcomes, used_up = [news], []
    while True:
        told, counts = checkpoint_counting(_step(waiting, news), "state", (OPEN, KEPT, DROPPED, USED_UP))
        news = told.where(F.col("state").isin(KEPT, DROPPED)).select("id", "state")
        outcomes.append(news)
        waiting = told.where(F.col("state") == OPEN)
        if counts[USED_UP]:
            used_up.append(told.where(F.col("state") == USED_UP).select("id"))
        if counts[OPEN] and (counts[KEPT] or counts[DROPPED]):
            continue
        if not used_up:
            break
        # All that is left waits for rows whose lists are used up; these look beyond them.
        again = reduce(DataFrame.unionByName, used_up)
        fates = reduce(DataFrame.unionByName, outcomes)
        standing = placed.rows.join(fates.where(F.col("state") == DROPPED), "id", "left_anti")
        longer = checkpoint(listed(placed.rows.join(again, "id", "left_semi"), standing))
        free = checkpoint(again.join(longer, "id", "left_anti").select("id", F.lit(KEPT).alias("state")))
        outcomes.append(free)
        waiting, used_up = waiting.unionByName(longer), []
        news = fates.unionByName(free)
    kept = reduce(DataFrame.unionByName, outcomes).where(F.col("state") == KEPT).select("id")
    if zero is not None:
        kept = kept.unionByName(zero)
    flags = kept.distinct().select("id", F.lit(True).alias("kept"))
    return rows.select("id").join(flags, "id", "left").select(
        "id", F.coalesce("kept", F.lit(False)).alias("kept")
    )
