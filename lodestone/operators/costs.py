"""Token accounting over the log of model calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranking import running_number

# Names of events and tags in the log.
CALL, FAILURE = "llm_call", "llm_error"
UNTAGGED, UNKNOWN = "UNTAGGED", "unknown"
PHASES = ("ingest", "retrieval_overhead", "agent_reasoning", "evaluation")
ACTORS = ("vector_embed", "graph_extract", "graph_cypher_gen", "langgraph_node", "llm_as_judge")


def total_tokens(prompt: Column, completion: Column, total: Column) -> Column:
    """The reported total, or the sum of its parts where it is missing or zero."""
    parts = F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0))
    return F.when(F.coalesce(total, F.lit(0)) != 0, total).otherwise(parts)


def latency_ms(seconds: Column) -> Column:
    return F.bround(seconds * 1000, 2)


def call_records(calls: DataFrame) -> DataFrame:
    """Log records of finished calls, with the defaults for everything a call left open.

    Expects ``ok, ts, run_id, phase, actor, variant_name, model, prompt_tokens,
    completion_tokens, reasoning_tokens, total_tokens, seconds, error``.  Failures carry
    no variant, tokens or latency.
    """
    ok = F.col("ok")
    given = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    tokens = lambda name: F.when(ok, given(name, 0))
    return calls.select(
        F.when(ok, CALL).otherwise(FAILURE).alias("event"),
        F.col("ts").alias("timestamp"),
        given("run_id", UNKNOWN).alias("run_id"),
        given("phase", UNTAGGED).alias("phase"),
        given("actor", UNTAGGED).alias("actor"),
        F.when(ok, given("variant_name", UNKNOWN)).alias("variant_name"),
        given("model", UNKNOWN).alias("model"),
        tokens("prompt_tokens").alias("prompt_tokens"),
        tokens("completion_tokens").alias("completion_tokens"),
        tokens("reasoning_tokens").alias("reasoning_tokens"),
        F.when(
            ok, total_tokens(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("total_tokens"))
        ).alias("total_tokens"),
        F.when(ok, latency_ms(F.col("seconds"))).alias("latency_ms"),
        F.when(~ok, given("error", "unknown error")).alias("error"),
    )


def untagged_calls(records: DataFrame) -> DataFrame:
    return records.where((F.col("event") == CALL) & ((F.col("phase") == UNTAGGED) | (F.col("actor") == UNTAGGED)))


def call_index(records: DataFrame, session: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Number the successful calls of each session from one; failures are left out."""
    return running_number(records.where(F.col("event") == CALL), session, order, name="call_index")


def cost_by(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Calls, failures, tokens and latency per combination of the keys."""
    ok = F.col("event") == CALL
    total = lambda name: F.coalesce(F.sum(F.when(ok, F.col(name))), F.lit(0)).alias(name)
    return records.groupBy(*keys).agg(
        F.count_if(ok).alias("calls"),
        F.count_if(F.col("event") == FAILURE).alias("failures"),
        total("prompt_tokens"),
        total("completion_tokens"),
        total("reasoning_tokens"),
        total("total_tokens"),
        F.sum(F.when(ok, F.col("latency_ms"))).alias("latency_ms"),
    )


def results_with_cost(results: DataFrame, records: DataFrame) -> DataFrame:
    """Each result with the cost of the calls of its run; 0 where none was logged.

    The log is summed per run before the join, so a run with very many calls is
    one row by then.
    """
    per_run = cost_by(records, ["run_id"]).select("run_id", "calls", "total_tokens", "latency_ms")
    joined = results.join(per_run, "run_id", "left")
    return joined.fillna(0, subset=["calls", "total_tokens"]).fillna(0.0, subset=["latency_ms"])
