"""Hybrid search over an entity index and a relation index, after the published two-level scheme.

The local side takes the nearest entities and the relations at them, the global
side the nearest relations and the entities at their ends.  Each query gets one
context text, or none if nothing was found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import incidence
from lodestone.operators.knn import knn_search
from lodestone.operators.ranking import top_k
from lodestone.session import checkpoint


def hybrid_hits(
    entities: DataFrame, relations: DataFrame, queries: DataFrame, k: int
) -> tuple[DataFrame, DataFrame]:
    """``(qid, source, place, name)`` of entities and ``(qid, source, place, eid)`` of relations.

    ``entities`` holds ``id, name, vec``; ``relations`` holds ``eid, subject, predicate, object,
    vec``; ``queries`` holds ``qid, vec``.
    """
    # Hits are written out first, so that the joins see how few they are.
    nearest = checkpoint(knn_search(entities.select("id", "vec"), queries, k).select("qid", "rank", "id"))
    local = checkpoint(entities.select("id", "name").join(nearest, "id").select("qid", "rank", "name"))
    corpus = relations.select(F.col("eid").alias("id"), "vec")
    overall = checkpoint(knn_search(corpus, queries, k).select("qid", "rank", F.col("id").alias("eid")))
    wanted = local.select(F.col("name").alias("node")).distinct()
    touching = incidence(relations).join(wanted, "node", "left_semi")
    near = top_k(touching, ["node"], [F.asc("eid")], k, rank="nth").select("node", "eid")
    at_entities = local.withColumnRenamed("name", "node").join(near, "node")
    edges = overall.select("qid", F.lit(0).alias("source"), F.col("rank").alias("place"), "eid")
    edges = edges.unionByName(
        at_entities.select("qid", F.lit(1).alias("source"), F.col("eid").alias("place"), "eid")
    )
    ends = overall.join(relations.select("eid", "subject", "object"), "eid").select(
        "qid", "rank", F.posexplode(F.array("subject", "object")).alias("side", "name")
    )
    names = local.select("qid", F.lit(0).alias("source"), F.col("rank").alias("place"), "name")
    names = names.unionByName(
        ends.select("qid", F.lit(1).alias("source"), (F.col("rank") * 2 + F.col("side")).alias("place"), "name")
    )
    once = lambda rows, key: (
        rows.groupBy("qid", key).agg(F.min(F.struct("source", "place")).alias("at"))
        .select("qid", "at.source", "at.place", key)
    )
    return once(names, "name"), once(edges, "eid")


def hybrid_search(
    entities: DataFrame, relations: DataFrame, queries: DataFrame, k: int
) -> DataFrame:
    """``(qid, context)``: one text per query that lists entities, then relations.

    A query's lists are bounded by its 2-sided top ``k``: at most ``3 k`` names and
    ``k + k * k`` relations.
    """
    names, edges = hybrid_hits(entities, relations, queries, k)
    sentence = F.concat_ws(" ", "subject", F.replace("predicate", F.lit("_"), F.lit(" ")), "object")
    lines = names.select("qid", F.lit(0).alias("part"), "source", "place", F.col("name").alias("line"))
    lines = lines.unionByName(
        edges.join(relations.select("eid", sentence.alias("line")), "eid").select(
            "qid", F.lit(1).alias("part"), "source", "place", "line"
        )
    )
    ordered = F.array_sort(F.collect_list(F.struct("part", "source", "place", "line")))
    section = lambda part: F.transform(
        F.filter("lines", lambda x: x["part"] == part), lambda x: x["line"]
    )
    context = F.concat(
        F.lit("Entities:\n"), F.array_join(section(0), "\n"),
        F.lit("\n\nRelations:\n"), F.array_join(section(1), "\n"),
    )
    return lines.groupBy("qid").agg(ordered.alias("lines")).select("qid", context.alias("context"))
