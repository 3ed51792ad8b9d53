"""Question answering: retrieve a context for every question, then ask the answering model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import context_block, user_prompt
from lodestone.plans.memories import Memory
from lodestone.session import checkpoint


class Agent:
    """Answers batches of questions from one memory.

    ``retrieve`` and ``reason`` are the two steps; a subclass may replace either
    or add steps in ``answer_many``.
    """

    def __init__(self, memory: Memory) -> None:
        self.memory = memory

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """Add ``context_used``, the passages found for each ``question`` in rank order."""
        hits = self.memory.search_many(questions.select("qid", F.col("question").alias("query")))
        lists = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("hits"))
        texts = F.transform("hits", lambda h: h["text"])
        joined = questions.join(lists, "qid", "left")
        return joined.withColumn(
            "context_used", F.coalesce(texts, F.array().cast("array<string>"))
        ).drop("hits")

    def reason(self, asked: DataFrame) -> DataFrame:
        """Add the reply struct ``r`` of the answering model."""
        prompt = user_prompt(context_block(F.col("context_used")), F.col("question"))
        return asked.withColumn("r", self.memory.models.answer(prompt))

    def answer_many(self, questions: DataFrame) -> DataFrame:
        """One result row per question ``(qid, question, expected)``."""
        config = self.memory.config
        # Written out once: the run ids are random and the calls cost money.
        tagged = self.retrieve(questions).withColumn("run_id", F.uuid())
        done = checkpoint(self.reason(tagged))
        self.memory._log(done, "r", "agent_reasoning", "langgraph_node", F.col("run_id"))
        return done.select(
            "qid",
            "run_id",
            F.lit(config.variant_name).alias("variant_name"),
            F.lit(config.agent_type).alias("agent_type"),
            "question",
            "expected",
            F.coalesce("r.reply", F.lit("")).alias("answer"),
            "context_used",
            F.array(F.lit("retrieve"), F.lit("reason")).alias("steps_taken"),
            F.lit(self.memory.name).alias("backend_name"),
        )

    def run(self, question: str) -> dict:
        rows = self.memory.spark.createDataFrame(
            [(0, question, "")], "qid long, question string, expected string"
        )
        response = self.answer_many(rows).first().asDict()
        fields = ("run_id", "question", "answer", "context_used", "steps_taken", "backend_name")
        return {name: response[name] for name in fields}

    def update_memory(self, fact: str) -> None:
        self.memory.update_fact(fact)
