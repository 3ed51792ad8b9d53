"""Helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bounds the memory of a worker's word table; the table starts anew when it is full.
_CACHED_WORDS = 100_000
# Rows of a bitmap built by ``maybe_in``; 64 bits each, 4 MB in all, whatever the input.
_BITMAP_ROWS = 1 << 18
# Grams hashed at once, few enough to stay in a processor's cache.
_GRAMS = 1 << 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str | Column) -> Column:
    """Text as UTF-8 bytes, so that Python workers need not decode it."""
    return (F.col(column) if isinstance(column, str) else column).cast("binary")


def _ascii_table() -> bytes:
    """Lower-cases A-Z, keeps a-z, 0-9 and all bytes of non-ASCII characters, blanks the rest."""
    out = bytearray(b" " * 128) + bytearray(range(128, 256))
    for c in b"abcdefghijklmnopqrstuvwxyz0123456789":
        out[c] = c
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        out[c] = c + 32
    return bytes(out)


_PLAIN = _ascii_table()


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.translate(_PLAIN).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; bytes methods touch ASCII only."""
    return text.lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= _CACHED_WORDS:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` word hashes, as signed 64-bit numbers in order of position."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    out = np.full(n, k, dtype=np.uint64)
    spare = np.empty(min(n, _GRAMS), dtype=np.uint64)
    for lo in range(0, n, _GRAMS):
        part = out[lo : lo + _GRAMS]
        half = spare[: len(part)]
        for i in range(lo, lo + k):
            part *= np.uint64(0x9E3779B97F4A7C15)
            part += words[i : i + len(part)]
            # ``mixed``, in place.
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                np.right_shift(part, np.uint64(shift), out=half)
                part ^= half
                if factor > 1:
                    part *= np.uint64(factor)
    return out.view(np.int64)


def grams_of_all(texts: list[np.ndarray], k: int) -> list[np.ndarray]:
    """``gram_hashes`` of every text, of all at once."""
    if not texts:
        return []
    grams = gram_hashes(np.concatenate(texts), k)
    ends = np.cumsum([len(t) for t in texts]).tolist()
    return [grams[end - len(t) : max(end - len(t), end - k + 1)] for t, end in zip(texts, ends, strict=True)]


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Arrays of one batch as a list column."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def per_batch(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` for work that looks at one batch at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def _place(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(_BITMAP_ROWS))


def _bit(c: Column) -> Column:
    return F.call_function("shiftrightunsigned", F.xxhash64(c), F.lit(58)).cast("int")


def bitmap(wanted: DataFrame, column: Column) -> DataFrame:
    """``(__place, __bits)``: a set of hashes in 2^24 bits, at most 2^18 rows whatever the input."""
    return wanted.select(
        _place(column).alias("__place"), F.call_function("shiftleft", F.lit(1).cast("long"), _bit(column)).alias("__bit")
    ).groupBy("__place").agg(F.bit_or("__bit").alias("__bits"))


def maybe_in(df: DataFrame, column: Column, wanted: DataFrame, wanted_column: Column) -> DataFrame:
    """Rows of ``df`` whose ``column`` may occur in ``wanted``; all that do are among them.

    The test is one bit of a bitmap of fixed size, which is broadcast.  Of a ``wanted`` beyond its
    size more other rows pass; nothing is lost, only less is saved.
    """
    tested = df.withColumn("__at", _place(column)).withColumn("__own", _bit(column))
    return (
        tested.join(F.broadcast(bitmap(wanted, wanted_column)), F.col("__at") == F.col("__place"))
        .where(F.call_function("shiftrightunsigned", F.col("__bits"), F.col("__own")).bitwiseAND(F.lit(1)) != 0)
        .select(*[F.col(f"`{c}`") for c in df.columns])
    )


def not_in(df: DataFrame, column: Column, wanted: DataFrame, wanted_column: Column) -> DataFrame:
    """The other rows of ``df``: those that ``maybe_in`` leaves out."""
    tested = df.withColumn("__at", _place(column)).withColumn("__own", _bit(column))
    bits = F.coalesce(F.col("__bits"), F.lit(0).cast("long"))
    return (
        tested.join(F.broadcast(bitmap(wanted, wanted_column)), F.col("__at") == F.col("__place"), "left")
        .where(F.call_function("shiftrightunsigned", bits, F.col("__own")).bitwiseAND(F.lit(1)) == 0)
        .select(*[F.col(f"`{c}`") for c in df.columns])
    )


class MaybeWords(dict):
    """The same test for words in Python workers: whether a word may be among the wanted ones."""

    def __init__(self, bits: np.ndarray) -> None:
        super().__init__()
        self.bits = bits

    @staticmethod
    def bits_of(wanted: DataFrame, column: Column) -> np.ndarray:
        """The bitmap as an array of 2 MB."""
        rows = bitmap(wanted, column).toArrow()
        bits = np.zeros(_BITMAP_ROWS, dtype=np.int64)
        bits[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
        return bits.view(np.uint64)

    def __missing__(self, word: str) -> bool:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word.encode(), 42)  # Spark's xxhash64 of a string
        value = self[word] = bool((int(self.bits[h % _BITMAP_ROWS]) >> (h >> 58)) & 1)
        return value


def groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``keys`` columns (integers, never null), of sorted input."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and last != tuple(c[0] for c in columns)
        starts = np.flatnonzero(change)
        begin = 0
        for at in starts:
            if at > begin:
                held.append(batch.slice(begin, at - begin))
            if held:
                yield pa.Table.from_batches(held)
            held, begin = [], at
        held.append(batch.slice(begin))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def arrays(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """A list column as one numpy array per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat = column.values.to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy()
    return [flat[ends[i] : ends[i + 1]] for i in range(len(column))]
