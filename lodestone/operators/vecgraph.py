"""Vector search over described triplets, widened by one hop in the entity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import triplet_text
from lodestone.operators.knn import knn_search
from lodestone.operators.ranking import top_k
from lodestone.session import checkpoint

# Fixed value: a context holds up to this many entries per requested hit.
CONTEXT_FACTOR = 4


def vecgraph_search(triplets: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(qid, rank, text)``: the hits by similarity, then their one-hop neighbourhood in ledger
    order, each text once, at most ``4 k``.

    ``triplets`` holds ``trip_id, subject, description, object, subject_key, object_key,
    embedding``; ``queries`` holds ``qid, vec``.  Only entities that were hit are expanded, and an
    entity contributes its first ``5 k`` distinct texts: no more than ``4 k`` of them
    can be shown and at most ``k`` were shown as hits, so a hub costs a constant.
    """
    text = triplet_text(F.col("subject"), F.col("description"), F.col("object"))
    ledger = triplets.select("trip_id", text.alias("text"), "subject_key", "object_key")
    corpus = triplets.select(F.col("trip_id").alias("id"), F.col("embedding").alias("vec"))
    # Written out, so that the joins below see how small the hits are.
    hits = checkpoint(knn_search(corpus, queries, k).select("qid", "rank", F.col("id").alias("trip_id")))
    shown = checkpoint(ledger.join(hits, "trip_id"))
    matched = shown.select(
        "qid", F.explode(F.array_distinct(F.array("subject_key", "object_key"))).alias("entity_key")
    ).distinct()
    ends = F.array_distinct(F.array("subject_key", "object_key"))
    around = (
        ledger.select(F.explode(ends).alias("entity_key"), "text", "trip_id")
        .join(matched.select("entity_key").distinct(), "entity_key", "left_semi")
        .groupBy("entity_key", "text")
        .agg(F.min("trip_id").alias("trip_id"))
    )
    near = top_k(around, ["entity_key"], [F.asc("trip_id")], (CONTEXT_FACTOR + 1) * k, rank="nth")
    entries = shown.select("qid", "text", F.lit(0).alias("source"), F.col("rank").alias("place"))
    entries = entries.unionByName(
        near.join(matched, "entity_key").select(
            "qid", "text", F.lit(1).alias("source"), F.col("trip_id").alias("place")
        )
    )
    once = entries.groupBy("qid", "text").agg(F.min(F.struct("source", "place")).alias("at"))
    order = [F.asc("at.source"), F.asc("at.place")]
    return top_k(once, ["qid"], order, CONTEXT_FACTOR * k).select("qid", "rank", "text")
