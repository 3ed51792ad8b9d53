"""Two-hop neighbourhood search over an edge list, seeded by words of the query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import edge_text, is_blank, words
from lodestone.operators.ranking import top_k
from lodestone.operators.substring import number_tokens, substring_matches
from lodestone.session import checkpoint

_SHORTEST_TOKEN = 3


def incidence(edges: DataFrame) -> DataFrame:
    """``(node, eid)``: both ends of every edge, a loop only once."""
    ends = F.array_distinct(F.array("subject", "object"))
    return edges.select(F.explode(ends).alias("node"), "eid")


def graph_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("subject", "object")).alias("node")).distinct()


def graph_size(edges: DataFrame) -> DataFrame:
    """One row ``(nodes, edges)``."""
    nodes = graph_nodes(edges).agg(F.count("*").alias("nodes"))
    return nodes.withColumn("edges", edges.agg(F.count("*")).scalar())


def seed_nodes(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """``(qid, node)``: nodes whose lower-cased name contains a query word of three or more characters."""
    asked = (
        queries.where(~is_blank(F.col("query")))
        .select("qid", F.explode(words(F.col("query"))).alias("token"))
        .where(F.length("token") >= _SHORTEST_TOKEN)
        .select("qid", F.lower("token").alias("token"))
        .distinct()
    )
    nodes = graph_nodes(edges).withColumn("name", F.col("node"))
    tokens = number_tokens(asked)
    hits = substring_matches(nodes, "node", "name", tokens)
    asked = asked.join(tokens, "token").select("qid", "token_no")
    return hits.join(asked, "token_no").select("qid", "node").distinct()


def graph_search(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(qid, rank, hop, eid, text)`` for edges ``(eid, subject, predicate, object)``.

    Edges are taken in order of (hop, eid), each once, and cut to ``k`` per query.

    What is cut early does not change the result.  A query with ``k`` edges at
    hop one needs no second hop, so only queries with fewer go on, and their
    frontier has fewer than ``2 k`` nodes.  At hop one a node can contribute only
    its ``k`` lowest edges, at hop two its ``2 k`` lowest, since fewer than ``k`` of them
    were seen before.  A node with any number of edges therefore costs a constant.
    """
    touching = incidence(edges)

    def lowest(nodes: DataFrame, n: int) -> DataFrame:
        """The ``n`` lowest edges at each of the given nodes."""
        wanted = nodes.select("node").distinct()
        return top_k(touching.join(wanted, "node", "left_semi"), ["node"], [F.asc("eid")], n, rank="nth")

    # Seeds and first hits are used several times and are small beside the
    # edges; written out, the joins see their real size.
    seeds = checkpoint(seed_nodes(edges, queries))
    first = seeds.join(lowest(seeds, k), "node").select("qid", "eid").distinct()
    hop1 = checkpoint(top_k(first, ["qid"], [F.asc("eid")], k).select("qid", "eid", F.lit(1).alias("hop")))
    unfinished = hop1.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") < k).select("qid")
    frontier = checkpoint(
        hop1.join(unfinished, "qid", "left_semi")
        .join(edges.select("eid", "subject", "object"), "eid")
        .select("qid", F.explode(F.array("subject", "object")).alias("node"))
        .distinct()
        .join(seeds, ["qid", "node"], "left_anti")
    )
    second = (
        frontier.join(lowest(frontier, 2 * k), "node")
        .select("qid", "eid")
        .distinct()
        .join(hop1.select("qid", "eid"), ["qid", "eid"], "left_anti")
        .withColumn("hop", F.lit(2))
    )
    best = top_k(hop1.unionByName(second), ["qid"], [F.asc("hop"), F.asc("eid")], k)
    sentence = edge_text(F.col("subject"), F.col("predicate"), F.col("object"))
    return checkpoint(best).join(edges, "eid").select("qid", "rank", "hop", "eid", sentence.alias("text"))
