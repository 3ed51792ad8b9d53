"""Streams on top of the batch operators: facts that arrive over time, and the call log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans.memories import Memory
from lodestone.sources.logs import CALL_LOG


def follow_facts(facts: DataFrame, memory: Memory, checkpoint_location: str) -> StreamingQuery:
    """Feed a stream of ``(doc_id, text)`` into a memory, one ingestion per micro-batch.

    The memory notes the batches it took, by the stream's checkpoint and their number: a batch that
    is replayed after a failure adds nothing.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        memory.ingest_batch(batch, checkpoint_location, batch_id)

    return (
        facts.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint_location)
        .trigger(availableNow=True)
        .start()
    )


def read_call_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The call log as a stream of new records."""
    return spark.readStream.schema(CALL_LOG).json(folder)
