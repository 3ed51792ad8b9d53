"""Make a question-answering dataset from a local dump of multi-hop samples.

``python -m lodestone.plans.prepare --source dump.parquet --output data/raw/hotpotqa --samples 500``
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.dataset import counts_per_key, extract_documents, extract_questions, stratified_sample
from lodestone.session import build_session, checkpoint
from lodestone.sources.datasets import read_samples, write_dataset


def prepare(spark: SparkSession, source: str, output: str, n: int = 500) -> DataFrame:
    """Write the tables of a stratified sample; returns its counts by type and by level."""
    # Numbers follow the order of the files; written out, so that they stay the same.
    samples = checkpoint(read_samples(spark, source).withColumn("idx", F.monotonically_increasing_id()))
    chosen = checkpoint(stratified_sample(samples, ["type", "level"], n).select("idx", "position"))
    picked = samples.join(chosen, "idx").drop("idx").withColumnRenamed("position", "idx")
    questions = extract_questions(picked).withColumnRenamed("idx", "qid")
    write_dataset(extract_documents(picked), questions, output)
    return counts_per_key(questions, ["type", "level"])


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--source", required=True, help="JSON lines or Parquet with the raw samples of one split")
    p.add_argument("--output", default="data/raw/hotpotqa_distractor", help="folder for the two tables")
    p.add_argument("--samples", type=int, default=500)
    args = p.parse_args(argv)
    prepare(build_session(), args.source, args.output, args.samples).orderBy("key", "value").show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
