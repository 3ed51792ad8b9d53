"""Dataset files: documents and questions, one JSON file or tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.dataset import expected_answer
from lodestone.sources.jsonarrays import json_array_items

_QUESTION = (
    "question: string, expected: string, answer: string, hops: int, chain: string, type: string, level: string"
)
_SAMPLE = (
    "id string, question string, answer string, type string, level string, "
    "context struct<title: array<string>, sentences: array<array<string>>>"
)


def _elements(spark: SparkSession, path: str, key: str, number: str, kind: str) -> DataFrame:
    """``(number, value)``: the elements of one array of a JSON file, read as ``kind``."""
    items = json_array_items(spark, path, [key])
    wrapped = F.from_json(F.concat(F.lit('{"value": '), F.col("item"), F.lit("}")), f"value {kind}")
    return items.select(F.col("item_no").alias(number), wrapped["value"].alias("value"))


def _is_file(path: str) -> bool:
    return path.endswith(".json")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, text)`` in file order.

    A ``.json`` file holds one object with a list of texts and is split like any text.  Any other path is a
    folder with a ``documents`` table in Parquet, read by as many tasks as it has
    splits; it brings its own ``doc_id``.
    """
    if not _is_file(path):
        return spark.read.schema("doc_id long, text string").parquet(f"{path}/documents")
    rows = _elements(spark, path, "documents", "doc_id", "string").where(F.col("value").isNotNull())
    return rows.select("doc_id", F.col("value").alias("text"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, question, expected)`` in file order; ``answer`` wins over ``expected``."""
    if not _is_file(path):
        table = spark.read.parquet(f"{path}/questions")
        return table.select("qid", F.coalesce("question", F.lit("")).alias("question"),
                            expected_answer(table).alias("expected"))
    rows = _elements(spark, path, "questions", "qid", f"struct<{_QUESTION}>").select("qid", "value.*")
    return rows.select(
        "qid",
        F.coalesce("question", F.lit("")).alias("question"),
        expected_answer(rows).alias("expected"),
    )


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Raw multi-hop samples from a local dump in JSON lines or Parquet, without an order of their own."""
    reader = spark.read.schema(_SAMPLE)
    return reader.parquet(path) if path.endswith(".parquet") else reader.json(path)


def write_dataset(documents: DataFrame, questions: DataFrame, folder: str) -> None:
    """Write ``(doc_id, text)`` and ``(qid, question, …)`` as the tables ``read_*`` expect."""
    documents.write.mode("overwrite").parquet(f"{folder}/documents")
    questions.write.mode("overwrite").parquet(f"{folder}/questions")
