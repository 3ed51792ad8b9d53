"""Preparation of question-answering datasets: stratified samples, paragraphs, questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import paragraph
from lodestone.operators.ranking import running_number, top_k
from lodestone.session import checkpoint


def _or_unknown(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("unknown")).alias(name)


def strata_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per combination of the keys, a missing key counting as ``unknown``."""
    return rows.select(*[_or_unknown(k) for k in keys]).groupBy(*keys).agg(F.count("*").alias("n"))


def counts_per_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(key, value, n)``: counts by each key on its own, in one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), _or_unknown(k).alias("value")) for k in keys])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.key", "p.value").agg(F.count("*").alias("n"))


def stratified_sample(rows: DataFrame, keys: Sequence[str], n: int, order: str = "idx") -> DataFrame:
    """``(position, order, *keys)`` of exactly ``n`` rows (all, if there are fewer), proportional to the strata.

    Each stratum gives its first ``max(1, round_half_even(n * size / total))`` rows.  Strata follow
    each other in the order they first appear; a surplus is cut from the end, a
    shortfall filled with the first rows not taken yet.
    """
    base = rows.select(order, *[_or_unknown(k) for k in keys])
    # Written out, so that the join sees its real size.
    strata = checkpoint(
        base.groupBy(*keys).agg(F.count("*").alias("size"), F.min(order).alias("first_seen"))
    )
    total = strata.agg(F.sum("size")).scalar()
    share = F.lit(n) * F.col("size") / total
    quotas = strata.withColumn("quota", F.greatest(F.lit(1), F.bround(share).cast("long")))
    # A quota never exceeds n, so each stratum is cut to n rows before the shuffle.
    head = top_k(base, list(keys), [F.asc(order)], max(1, n), rank="nth")
    taken = checkpoint(head.join(quotas, list(keys)).where(F.col("nth") <= F.col("quota")))
    # A shortfall needs fewer than n rows, and fewer than n are taken then, so
    # the first 2 n rows hold enough of them.
    spare = base.orderBy(order).limit(2 * n).join(taken.select(order), order, "left_anti")
    ranked = taken.select(order, *keys, F.lit(0).alias("late"), "first_seen", "nth").unionByName(
        spare.select(order, *keys, F.lit(1).alias("late"), F.lit(0).cast("long").alias("first_seen"),
                     F.col(order).cast("long").alias("nth"))
    )
    chosen = ranked.orderBy("late", "first_seen", "nth").limit(n)
    place = Window.orderBy("late", "first_seen", "nth")
    # At most n rows are left here.
    return chosen.select(F.row_number().over(place).cast("long").alias("position"), order, *keys)


def distinct_paragraphs(samples: DataFrame) -> DataFrame:
    """``(idx, pos, text)`` of samples ``(idx, context<title, sentences>)``: each paragraph at its first place.

    Titles and sentence lists are paired up to the shorter of the two.
    """
    pairs = F.slice(
        F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences")),
        F.lit(1),
        F.least(F.size("context.title"), F.size("context.sentences")),
    )
    exploded = samples.where(F.col("context").isNotNull()).select("idx", F.posexplode(pairs).alias("pos", "p"))
    place = F.struct(F.col("idx").cast("long").alias("idx"), "pos")
    texts = exploded.select(place.alias("place"), paragraph(F.col("p.title"), F.col("p.sentences")).alias("text"))
    return texts.groupBy("text").agg(F.min("place").alias("place")).select("place.idx", "place.pos", "text")


def extract_documents(samples: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of samples: distinct paragraphs, numbered from 0 in the order of their first places."""
    numbered = running_number(distinct_paragraphs(samples), [], ["idx", "pos"], name="doc_id")
    return numbered.select((F.col("doc_id") - 1).alias("doc_id"), "text")


def extract_questions(samples: DataFrame) -> DataFrame:
    """``(idx, question, answer, type, level)`` with ``unknown`` for what is missing."""
    return samples.select("idx", "question", "answer", _or_unknown("type"), _or_unknown("level"))


def expected_answer(questions: DataFrame) -> Column:
    """``answer`` if there is one, else ``expected``, else nothing."""
    candidates = [F.col(c) for c in ("answer", "expected") if c in questions.columns]
    return F.coalesce(*candidates, F.lit(""))
