"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import checkpoint


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has an edge; the root is the smallest node of the component.

    Each round joins every node to the smallest node it knows, first over its larger, then over
    its smaller neighbours; the number of rounds grows with the logarithm of the longest chain.
    Minima are combined before the shuffle, and the join with them is one adaptive execution may
    split, so a star of any size is no hot group.  Rows with a null end and loops are ignored.
    """
    known = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).distinct()
    known = checkpoint(known)
    state = _state(known)
    while state[0]:
        both = known.unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("n"), F.least("u", "m").alias("m")
        )
        large = both.join(least, F.col("u") == F.col("n")).where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        small = large.join(least, F.col("u") == F.col("n")).select(
            F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")
        ).where("u != v")
        following = checkpoint(
            small.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()
        )
        after = _state(following)
        known = following
        if after == state:
            break
        state = after
    roots = known.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return known.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
