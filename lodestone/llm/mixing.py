"""Mixing sources to target weights, in DataFrame functions only.

* **Blocks.** The words of a source, its documents in order of their ids, are packed into blocks of
  fixed length; a document becomes pieces of blocks.  Offsets come from range partitions and a
  small table of their sums, so a source of any size is spread over many tasks.
* **Draws.** A source gets as many slots as blocks make up its target.  Its slots are thrown over
  the output shards at random, which makes its counts per shard a multinomial draw whose total is
  exact.
* **Permutations.** Slot ``j`` of a source of ``n`` blocks takes block ``p(j mod n)`` of pass
  ``j div n``, where ``p`` is the swap-or-not shuffle (Hoang, Morris, Rogaway 2012) keyed by source,
  pass and seed: a permutation of any ``n`` that needs neither sorting nor state.
* **Join.** Slots and pieces meet by (source, block), both spread evenly over the cluster.

Everything is a function of the data and the seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import checkpoint

# The weights of sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 64
_ROUNDS = 16


def n_words(text: str = "text") -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def numbered_sums(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the earlier rows of the same group.

    Rows equal in ``order`` are taken in order of ``value``; if they agree in that too, they are alike.
    """
    keys = [*by, *order, value]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pinned = checkpoint(df.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()))
    sums = pinned.groupBy(*by, "__part").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("__offset", F.coalesce(F.sum("__sum").over(earlier), F.lit(0))).select(
        *[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__of"), "__offset"
    )
    match = F.col("__part") == F.col("__of")
    for c in by:
        match &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    within = Window.partitionBy(*by, "__part").orderBy(*order, value).rowsBetween(Window.unboundedPreceding, -1)
    local = pinned.withColumn("__local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return local.join(offsets, match).withColumn("before", F.col("__local") + F.col("__offset")).select(
        *df.columns, "before"
    )


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size, weight, target)`` from ``(source, source_size)``.

    Sources share ``share`` times the sum of all sizes by weight.  A target stops at ``most`` times
    its source's size; the excess is shared again until no target is above.  Only sums of the rows
    still sharing reach the driver.
    """
    ordered = sizes.select(F.col("source").isNull().alias("last"), "source", "source_size")
    ranked = numbered_sums(ordered.withColumn("one", F.lit(1).cast("long")), [], ["last", "source"], "one")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("before") % len(weights) + 1).cast("int"))
    held = checkpoint(ranked.select("source", "source_size", weight.cast("double").alias("weight")))
    total = held.agg(F.sum("source_size")).first()[0] or 0
    most_words = F.col("source_size") * F.lit(float(most))
    level = 0.0
    while True:
        # A source whose share at this level exceeds its most stops there.
        stopped = most_words < F.col("weight") * level
        taken, sharing = held.agg(
            F.sum(F.when(stopped, most_words).otherwise(0.0)), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight")))
        ).first()
        if not sharing:
            break
        following = (share * total - taken) / sharing
        if following <= level:
            break
        level = following
    return held.withColumn("target", F.least(most_words, F.col("weight") * level))


def shuffled(index: Column, n: Column, key: Column, rounds: int = _ROUNDS) -> Column:
    """The place of ``index`` in a keyed pseudorandom permutation of ``0 .. n - 1``."""

    def swap(x: Column, r: Column) -> Column:
        turn = F.pmod(F.xxhash64(key, r), n)
        partner = F.pmod(turn - x, n)
        return F.when(F.xxhash64(F.greatest(x, partner), key, r) % 2 == 0, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), swap)


def mixture(
    docs: DataFrame, seed: int = 7, block_words: int = BLOCK_WORDS, shard_words: int = 1 << 20,
    share: float = 1.5, most: float = 2.0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of ``docs(doc_id, text, source)``.

    Returns ``documents(doc_id, source, size, source_size, target, before)``, one row per row of
    ``docs``; ``slots(shard, source, pass, slot, block)``, the training blocks in their shards; and
    ``pieces(source, block, doc_id, before, words)``, the parts of documents that blocks consist of.
    A null source is a source of its own, the last one; texts without words have size 0 and no pieces.
    Rows that repeat an id are packed one after the other.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words().alias("size"))
    packed = checkpoint(numbered_sums(sized, ["source"], ["doc_id"], "size"))
    sources = checkpoint(targets(packed.groupBy("source").agg(F.sum("size").alias("source_size")), share, most))
    documents = packed.join(
        sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))
    ).select("doc_id", "source", "size", "source_size", "target", "before")

    blocks = F.ceil(F.col("source_size") / block_words)
    # The last block is shorter, so the mean length of a block tells how many make up the target.
    filled = sources.where("source_size > 0").withColumn("blocks", blocks).withColumn(
        "slots", F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")), F.floor(most * F.col("blocks"))).cast("long")
    )
    shards = F.lit(max(1, round(share * (sources.agg(F.sum("source_size")).first()[0] or 0) / shard_words)))
    # A row per run of slots first, so that the slots of a large source are made by many tasks.
    run = 1 << 12
    runs = filled.where("slots > 0").select(
        "source", "blocks", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(run).cast("long"))).alias("begin")
    )
    key = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.floor(F.col("slot") / F.col("blocks")), F.lit(seed))
    slots = (
        runs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source", "begin")
        .select("source", "blocks", F.explode(F.sequence("begin", F.least(F.col("begin") + run, F.col("slots")) - 1)).alias("slot"))
        .select(
            F.pmod(F.xxhash64("source", "slot", F.lit(seed + 1)), shards).alias("shard"), "source",
            F.floor(F.col("slot") / F.col("blocks")).alias("pass"), "slot",
            shuffled(F.col("slot") % F.col("blocks"), F.col("blocks"), key).alias("block"),
        )
    )
    end = F.col("before") + F.col("size")
    pieces = packed.where("size > 0").select(
        "source", "doc_id", "before", "size",
        F.explode(F.sequence(F.floor(F.col("before") / block_words), F.floor((end - 1) / block_words))).alias("block"),
    ).select(
        "source", "block", "doc_id", "before",
        (F.least(end, (F.col("block") + 1) * block_words) - F.greatest("before", F.col("block") * block_words)).alias("words"),
    )
    return documents, slots, pieces


def taken(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``: the words the mix takes of every row, repeats counted."""
    documents, slots, pieces = mixture(docs, **options)
    times = slots.groupBy("source", "block").agg(F.count("*").alias("times"))
    # Slots are made of few rows, from whose size the planner would take them for small.
    left, right = pieces.alias("p"), times.hint("merge").alias("t")
    used = (
        left.join(right, F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.block") == F.col("t.block")))
        .groupBy(F.col("p.source").alias("__source"), F.col("p.before").alias("__before"), F.col("p.doc_id").alias("__doc"))
        .agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    )
    # Rows with words differ in where they begin; rows without take nothing.
    match = (
        F.col("source").eqNullSafe(F.col("__source")) & (F.col("before") == F.col("__before"))
        & F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("size") > 0)
    )
    return documents.join(used.hint("merge"), match, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
