"""Token-overlap retrieval: passages ranked by how many query tokens they contain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import words
from lodestone.operators.ranking import top_k
from lodestone.operators.substring import number_tokens, substring_matches
from lodestone.session import broadcast_if_small


def query_token_counts(queries: DataFrame) -> DataFrame:
    """``(qid, token, weight)``: a token counts as often as the query repeats it."""
    return (
        queries.select("qid", F.explode(words(F.col("query"))).alias("token"))
        .select("qid", F.lower("token").alias("token"))
        .groupBy("qid", "token")
        .agg(F.count("*").alias("weight"))
    )


def overlap_search(passages: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(qid, rank, doc_id, score)`` for passages ``(doc_id, text)`` and queries ``(qid, query)``.

    Tokens match as substrings, whatever the case; passages without a match are
    left out; ties keep the order of ``doc_id``.
    """
    counts = query_token_counts(queries)
    tokens = number_tokens(counts)
    hits = substring_matches(passages, "doc_id", "text", tokens)
    weights = counts.join(tokens, "token").select("qid", "token_no", "weight")
    weights = broadcast_if_small(weights, per_row=48)
    scored = hits.join(weights, "token_no").groupBy("qid", "doc_id").agg(F.sum("weight").alias("score"))
    best = top_k(scored, ["qid"], [F.desc("score"), F.asc("doc_id")], k)
    return best.select("qid", "rank", "doc_id", "score")
