"""A training corpus from raw documents: filter, deduplicate, decontaminate, mix."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodestone.llm import bottomk, decontam, linededup, mixing, toxicity  # noqa: E402
from lodestone.llm.common import table  # noqa: E402
from lodestone.session import checkpoint, checkpoint_dir  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity model does not reject; it learns from labelled rows among them."""
    return toxicity.accepted(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines seen earlier; documents of which nothing remains go."""
    # Written once: a filter pushed into the projection would split the texts anew for every line.
    done = checkpoint(linededup.without_repeats(docs))
    emptied = (F.col("__removed") > 0) & (F.trim(F.col("text")) == "")
    if "n_chars" in docs.columns:
        counted = F.when(F.col("__removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        done = done.withColumn("n_chars", counted.otherwise(F.col("n_chars")))
    return done.where(~emptied).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near-duplicates, that of the smallest id; a null id comes last.

    Rows are told apart by a number, so rows that share an id, or have none, are judged each for itself.
    """
    numbered = checkpoint(docs.withColumn("__row", F.monotonically_increasing_id()))
    judged = bottomk.near_duplicates(numbered.select(F.col("__row").alias("doc_id"), "text"))
    grouped = judged.select(F.col("doc_id").alias("__member"), F.col("component_id").alias("__group")).join(
        numbered.select("__row", F.col("doc_id").alias("__id")), F.col("__member") == F.col("__row")
    )
    first = F.min(F.struct(F.col("__id").isNull(), F.col("__id"), F.col("__row")))
    kept = grouped.groupBy("__group").agg(first.alias("f")).select(F.col("f.__row").alias("__kept"))
    return numbered.join(kept, F.col("__row") == F.col("__kept"), "left_semi").select(docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of benchmark items, where these make up enough of a text."""
    return decontam.cleaned(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.taken(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
]

# Learned scores, sketches and permutations are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written to the shared folder and read again."""
    import uuid

    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark)}/corpus-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
