"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A relation is broadcast only if its measured size stays below this.
BROADCAST_BYTES = 64 * 1024 * 1024
# Bytes of files behind one task that takes texts apart: what it holds is a multiple of them.
PIECE_BYTES = 8 * 1024 * 1024


def build_session(app_name: str = "lodestone", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a folder of our own only for a local master."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-ckpt-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and continue from there.

    Unlike a checkpointed plan, a table carries no constraints from round to
    round, which would make the plans of a long loop grow, and its real size is
    known to the optimizer.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint_counting(df: DataFrame, column: str, values: Sequence[int]) -> tuple[DataFrame, dict[int, int]]:
    """``checkpoint``, and how many rows hold each of ``values``, counted while they are written."""
    seen = Observation()
    counts = [F.sum(F.when(F.col(column) == v, 1).otherwise(0)).alias(f"v{v}") for v in values]
    written = checkpoint(df.observe(seen, *counts))
    found = seen.get
    return written, {v: found.get(f"v{v}") or 0 for v in values}


def measured_bytes(df: DataFrame, per_row: int = 16, payload: Column | None = None) -> int:
    """Size of a relation: a fixed cost per row plus the measured length of ``payload``."""
    extra = F.coalesce(F.sum(payload.cast("long")), F.lit(0)) if payload is not None else F.lit(0)
    rows, held = df.agg(F.count("*"), extra).first()
    return int(rows) * per_row + int(held)


def broadcast_if_small(
    df: DataFrame, per_row: int = 16, payload: Column | None = None, limit: int | None = None
) -> DataFrame:
    """Hint a broadcast for a relation whose measured size is below the limit.

    A larger one is left alone: the join then shuffles both sides and adaptive
    execution splits its skewed partitions.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    return F.broadcast(df) if measured_bytes(df, per_row, payload) <= limit else df


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; for a file scan, the size of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _leaf_bytes(df: DataFrame) -> int:
    """Size of the files and rows under a plan, whatever its columns and joins are estimated to make of them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def input_pieces(df: DataFrame) -> int:
    """Tasks for what is made of ``df``: at least one per core, and one per ``PIECE_BYTES`` of its files."""
    size = _leaf_bytes(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    # The estimate of rows that come from outside is the largest number there is.
    return cores if size >= 1 << 50 else max(cores, -(-size // PIECE_BYTES))


def spread_texts(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition texts into pieces of a bounded size, at least one per core.

    Taking texts apart makes many rows of one, which a task then groups; with the number of pieces in
    proportion to the input, no task holds more of them in a large corpus than in a small one.
    Grouping by ``key`` needs no further shuffle.  Rows of unknown size keep their partitions.
    """
    size = _leaf_bytes(df)
    # The estimate of rows that come from outside is the largest number there is.
    if size >= 1 << 50:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PIECE_BYTES)), key)


def spread_small_scan(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a scan that is too small to be split over all cores.

    A file of one row group is read by one task, whatever heavy expressions
    follow.  A scan with a full-sized split per core is left as it is, so large
    inputs are never shuffled here.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = 128 * 1024 * 1024
    if estimated_bytes(df) >= split * cores:
        return df
    return df.repartition(cores, key)
