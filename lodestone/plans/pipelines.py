"""The two phases of an experiment: ingest a dataset, then answer its questions."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import ExperimentConfig
from lodestone.operators.costs import CALL, untagged_calls
from lodestone.operators.ranking import running_number
from lodestone.plans.agent import Agent
from lodestone.plans.memories import Memory, build_memory
from lodestone.plugins import Models
from lodestone.session import checkpoint
from lodestone.sources.datasets import read_documents, read_questions
from lodestone.sources.logs import last_call, results_path, session_path, write_lines

logger = logging.getLogger(__name__)


def flush_calls(memory: Memory, path: str) -> None:
    """Append the noted model calls to a session's log, numbered in time order behind those it holds."""
    if not memory.calls:
        return
    noted = checkpoint(reduce(lambda a, b: a.unionByName(b), memory.calls))
    memory.calls.clear()
    good = running_number(noted.where(noted.event == CALL), [], ["timestamp", "run_id"], name="call_index")
    good = good.withColumn("call_index", F.col("call_index") + F.lit(last_call(noted.sparkSession, path)))
    failed = noted.where(noted.event != CALL)
    write_lines(good.unionByName(failed, allowMissingColumns=True), path, append=True)
    if not untagged_calls(noted).isEmpty():
        logger.warning("some model calls carry no phase or actor")


def run_ingest(
    spark: SparkSession, config: ExperimentConfig, models: Models, data_dir: str, log: str | None = None
) -> Memory | None:
    """Replace the content of the variant's memory by the documents of its dataset.

    A dataset without documents leaves the memory as it is.
    """
    documents = read_documents(spark, f"{data_dir}/{config.data_file}")
    if documents.isEmpty():
        logger.warning("no documents in %s", config.data_file)
        return None
    memory = build_memory(spark, config, models)
    memory.reset()
    memory.ingest_documents(documents)
    flush_calls(memory, log or session_path(config.telemetry.output_dir, config.variant_name))
    return memory


def run_qa(
    spark: SparkSession,
    config: ExperimentConfig,
    models: Models,
    data_dir: str,
    output_dir: str,
    log: str | None = None,
) -> str:
    """Answer all questions of the variant's dataset; returns the path of the results."""
    questions: DataFrame = read_questions(spark, f"{data_dir}/{config.data_file}")
    if questions.isEmpty():
        logger.warning("no questions in %s", config.data_file)
        return f"{output_dir}/{config.variant_name}_results.jsonl"
    memory = build_memory(spark, config, models)
    results = Agent(memory).answer_many(questions)
    path = results_path(output_dir, config.variant_name)
    write_lines(results.drop("qid"), path)
    flush_calls(memory, log or session_path(config.telemetry.output_dir, config.variant_name))
    return path
