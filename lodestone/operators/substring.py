"""Which tokens occur as a substring of which texts, as an equi-join on grams.

A token holds no white space, so it lies inside one word of the text.  Tokens
of up to eight characters are their own gram; a longer one is found by one of
its grams of eight characters, the one that the fewest tokens hold.  Words
probe the table of the tokens with their own grams, and a long token met there
is searched in the word.  The work of a word grows with its own length, whatever the lengths
of the tokens, and texts are not shuffled while the table is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import words
from lodestone.session import broadcast_if_small, checkpoint, spread_texts

# Characters of a gram; shorter tokens are grams of their own length, so
# most tokens are met exactly, without a search.
_GRAM = 8
# Longer words are cut into overlapping pieces of about this many characters,
# as finding the place of a gram takes time up to its distance from the start.
_PIECE = 256


def number_tokens(tokens: DataFrame) -> DataFrame:
    """``(token, token_no)`` of the distinct tokens; written out, so that the numbers stay the same."""
    distinct = tokens.select("token").distinct()
    return checkpoint(distinct.withColumn("token_no", F.monotonically_increasing_id()))


def _pieces(word: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word)), F.lit(_PIECE))
    cut = F.transform(starts, lambda i: F.substr(word, i, F.lit(_PIECE + _GRAM - 1)))
    return F.when(F.length(word) <= _PIECE, F.array(word)).otherwise(cut)


def gram_table(tokens: DataFrame) -> DataFrame:
    """``(gram, token, token_no)``: every token under the gram that the fewest tokens hold."""
    size = F.least(F.length("token"), F.lit(_GRAM))
    pieces = tokens.select("token", "token_no", F.explode(_pieces(F.col("token"))).alias("piece"))
    places = pieces.select("token", "token_no", "piece", F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("start"))
    held = (
        places.where(F.col("start") + size <= F.length("piece") + 1)
        .select("token_no", F.substr("piece", F.col("start"), size).alias("gram"))
        .distinct()
    )
    shared = held.groupBy("gram").agg(F.count("*").alias("n"))
    best = held.join(shared, "gram").groupBy("token_no").agg(F.min(F.struct("n", "gram")).alias("best"))
    return best.join(tokens, "token_no").select(F.col("best.gram").alias("gram"), "token", "token_no")


def substring_matches(texts: DataFrame, id_col: str, text_col: str, tokens: DataFrame) -> DataFrame:
    """Distinct ``(id, token_no)`` pairs where the lower-cased text contains the token.

    ``tokens`` are numbered, lower-cased, non-empty and without white space.
    """
    table = checkpoint(gram_table(tokens))
    # At most one row per length of a gram.
    sizes = [row["size"] for row in table.select(F.length("gram").alias("size")).distinct().collect()]
    texts = spread_texts(texts.select(id_col, text_col), id_col)
    said = texts.select(id_col, F.explode(F.array_distinct(words(F.lower(F.col(text_col))))).alias("word"))
    # Plain generators instead of nested array functions: the grams and the
    # probe of the table compile into one loop.
    pieces = said.select(id_col, "word", F.explode(_pieces(F.col("word"))).alias("piece"))
    places = pieces.select(id_col, "word", "piece", F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("start"))
    sized = places.select(id_col, "word", "piece", "start", F.explode(F.lit(sizes).cast("array<int>")).alias("size"))
    probes = sized.where(F.col("start") + F.col("size") <= F.length("piece") + 1).select(
        id_col, "word", F.substr("piece", F.col("start"), F.col("size")).alias("gram")
    )
    table = broadcast_if_small(table, per_row=56, payload=F.octet_length("token"))
    exact = F.length("token") <= _GRAM
    met = probes.join(table, "gram").where(exact | F.contains("word", "token"))
    return met.select(id_col, "token_no").distinct()
