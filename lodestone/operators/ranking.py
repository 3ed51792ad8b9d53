"""Top-k per group and row numbers that never gather a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import checkpoint

# Spark's default for spark.sql.optimizer.windowGroupLimitThreshold.
_GROUP_LIMIT = 1000
_SALTS = 256


def top_k(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of every group, with their 1-based rank.

    Spark cuts each map partition to ``k`` rows per group before the shuffle
    (``WindowGroupLimit``), so a group of any size reaches its final task as at
    most ``k`` rows per map partition.
    """
    if k > _GROUP_LIMIT:
        # Beyond what Spark cuts on the map side, cut salted parts of a group first.
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(_SALTS))
        part = Window.partitionBy(*by, "__salt").orderBy(*order)
        df = (
            df.withColumn("__salt", salt)
            .withColumn("__in_part", F.row_number().over(part))
            .where(F.col("__in_part") <= k)
            .drop("__salt", "__in_part")
        )
    window = Window.partitionBy(*by).orderBy(*order)
    numbered = df.withColumn(rank, F.row_number().over(window))
    return numbered.where(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    return top_k(df, keys, order, 1, rank="__first").drop("__first")


def running_number(
    df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "row_no"
) -> DataFrame:
    """1-based position of every row within its group, for groups of any size.

    Rows are range-partitioned on (group, order), which spreads a large group
    over many partitions.  Each partition numbers its own part; a small table of
    part sizes gives the offset of each part.
    """
    keys = [*by, *order]
    # The number of parts is given, so that small inputs are still split the
    # same way, and the parts are pinned before they are counted.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id())
    pinned = checkpoint(spread)
    sizes = pinned.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)],
        F.col("__part").alias("__offset_part"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
    )
    within = Window.partitionBy(*by, "__part").orderBy(*order)
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)]
    condition = F.col("__part") == F.col("__offset_part")
    for part in same:
        condition = condition & part
    numbered = pinned.withColumn("__local", F.row_number().over(within))
    return (
        numbered.join(offsets, condition, "left")
        .withColumn(name, F.col("__local").cast("long") + F.col("__offset"))
        .drop("__part", "__local", "__offset", "__offset_part", *[f"__k{i}" for i in range(len(by))])
    )
