"""Overlapping word chunks of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import chunk_at, chunk_starts, is_blank, strip_ws, text_md5, words
from lodestone.session import spread_small_scan


def clean_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Strip the text and leave blank documents out."""
    return docs.where(~is_blank(F.col(text_col))).withColumn(text_col, strip_ws(F.col(text_col)))


def chunk_documents(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """``(doc_id, chunk_no, chunk, source_hash)`` of documents ``(doc_id, text)``.

    A chunk holds ``size`` words and shares ``overlap`` words with the one
    before; the last chunk ends with the text.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the chunk size")
    docs = spread_small_scan(docs.select("doc_id", "text"), "doc_id")
    split = clean_documents(docs).select("doc_id", words(F.col("text")).alias("words"))
    texts = F.transform(
        chunk_starts(F.size("words"), size, overlap),
        lambda number: chunk_at(F.col("words"), number, size, overlap),
    )
    chunks = split.select("doc_id", F.posexplode(texts).alias("chunk_no", "chunk"))
    return chunks.withColumn("source_hash", text_md5(F.col("chunk")))
