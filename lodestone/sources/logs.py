"""JSON-lines sinks: answers and the log of model calls."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALL_LOG = (
    "event string, timestamp timestamp, call_index long, run_id string, phase string, actor string, "
    "variant_name string, model string, prompt_tokens long, completion_tokens long, reasoning_tokens long, "
    "total_tokens long, latency_ms double, error string"
)


def stamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")


def results_path(folder: str, variant: str) -> str:
    return f"{folder.rstrip('/')}/{variant}_{stamp()}_results.jsonl"


def session_path(folder: str, variant: str) -> str:
    return f"{folder.rstrip('/')}/{variant}_{stamp()}_telemetry.jsonl"


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object per row; characters outside ASCII are written as they are."""
    df.write.mode("append" if append else "errorifexists").json(path)


def last_call(spark: SparkSession, path: str) -> int:
    """The largest call index of a log, 0 if there is none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return 0
    return read_calls(spark, path).agg(F.max("call_index")).first()[0] or 0


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALL_LOG).json(path)
