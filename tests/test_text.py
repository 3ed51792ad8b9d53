from pyspark.sql import functions as F

from lodestone.functions import text as T


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


def test_white_space_follows_unicode(spark):
    padded = "\x1c  　a b\t\x1f"
    assert one(spark, padded, T.strip_ws) == padded.strip()
    assert one(spark, padded, T.words) == padded.split()
    assert one(spark, "   ", T.is_blank) is True


def test_tokens_fold_case_and_single_marks(spark):
    tokens = one(spark, "Été ṣa éx STRAßE ệ İx don't 3.5", T.fts_tokens)
    assert tokens == ["ete", "sa", "ex", "straße", "ệ", "ix", "don", "t", "3", "5"]


def test_phrases_drop_query_operators(spark):
    assert one(spark, '"a"* (b-c)+d^e:f ?', T.quoted_phrases) == ["a", "b", "c", "d", "e", "f", "?"]
    assert one(spark, '"*()', T.quoted_phrases) == []


def test_context_and_prompt(spark):
    empty = spark.range(1).select(T.context_block(F.array().cast("array<string>")).alias("y")).first().y
    assert empty == "No context available."
    block = spark.range(1).select(T.context_block(F.array(F.lit("p"), F.lit("q"))).alias("y")).first().y
    assert block == "p\nq"
    assert one(spark, "why", lambda q: T.user_prompt(F.lit("c"), q)) == "Context:\nc\n\nQuestion: why"


def test_choice_of_a_numbered_name(spark):
    block = spark.range(1).select(T.numbered_block(F.array(F.lit("A"), F.lit("B"))).alias("y")).first().y
    assert block == '  1. "A"\n  2. "B"'
    replies = {"1": 1, " 2 ": 2, "0": None, "3": None, "-1": None, "one": None, "1.0": None, "": None, "+2": 2}
    for reply, wanted in replies.items():
        assert one(spark, reply, lambda r: T.choice_index(r, F.lit(2))) == wanted, reply


def test_edge_and_triplet_texts(spark):
    row = spark.range(1).select(
        T.edge_text(F.lit("A"), F.lit("born_in_x"), F.lit("B")).alias("e"),
        T.triplet_text(F.lit("A"), F.lit("d"), F.lit("B")).alias("t"),
    ).first()
    assert (row.e, row.t) == ("A born in x B", "[A] d [B]")
