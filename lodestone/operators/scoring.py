"""Exact match and token F1 of answers, by the published definition for HotpotQA."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import words

# Fixed values of the metric: ASCII punctuation, articles, and answers that must match exactly.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")
CLOSED_ANSWERS = ("yes", "no", "noanswer")


def answer_tokens(text: Column) -> Column:
    """Lower-cased words without punctuation and articles."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    spaced = F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " ")
    return words(spaced)


def score_answers(answers: DataFrame) -> DataFrame:
    """``(id, exact_match, f1)`` of ``(id, answer, expected)``."""
    sides = answers.select(
        "id",
        answer_tokens(F.col("answer")).alias("got"),
        answer_tokens(F.col("expected")).alias("gold"),
    )
    tokens = sides.select(
        "id",
        F.explode(
            F.concat(
                F.transform("got", lambda t: F.struct(t.alias("t"), F.lit(0).alias("side"))),
                F.transform("gold", lambda t: F.struct(t.alias("t"), F.lit(1).alias("side"))),
            )
        ).alias("x"),
    )
    shared = (
        tokens.groupBy("id", F.col("x.t").alias("token"))
        .agg(F.count_if(F.col("x.side") == 0).alias("a"), F.count_if(F.col("x.side") == 1).alias("b"))
        .groupBy("id")
        .agg(F.sum(F.least("a", "b")).alias("shared"))
    )
    got_text, gold_text = F.array_join("got", " "), F.array_join("gold", " ")
    facts = sides.select(
        "id",
        (got_text == gold_text).cast("int").alias("exact_match"),
        F.size("got").alias("n_got"),
        F.size("gold").alias("n_gold"),
        (
            (got_text.isin(*CLOSED_ANSWERS) | gold_text.isin(*CLOSED_ANSWERS)) & (got_text != gold_text)
        ).alias("closed_miss"),
    )
    joined = facts.join(shared, "id", "left")
    common = F.coalesce("shared", F.lit(0))
    precision, recall = common / F.col("n_got"), common / F.col("n_gold")
    f1 = F.when((common == 0) | F.col("closed_miss"), F.lit(0.0)).otherwise(
        2 * precision * recall / (precision + recall)
    )
    return joined.select("id", "exact_match", f1.alias("f1"))


def score_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count("*").alias("questions"), F.avg("exact_match").alias("em"), F.avg("f1").alias("f1")
    )
