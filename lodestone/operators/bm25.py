"""Full-text retrieval ranked by BM25.

A query is a disjunction of phrases, one per white-space word.  A phrase that
folds to several tokens matches only where they stand next to each other, and
its document and term frequencies are those of the whole phrase.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import fts_tokens, is_blank, quoted_phrases
from lodestone.operators.blockmax import Weights, top_sums
from lodestone.operators.ranking import top_k
from lodestone.session import BROADCAST_BYTES, checkpoint, spread_small_scan, spread_texts

# BM25 constants and the floor of the inverse document frequency.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6

# Scores closer than this are a tie, so that the order in which a sum was
# formed on the cluster cannot decide a rank.
_SCORE_DIGITS = 10


@dataclass(frozen=True)
class Phrases:
    """The phrases of a batch of queries, with what was measured about them.

    ``table`` is ``(qid, phrase, tokens, n, weight)``; a phrase a query repeats
    is counted in ``weight``.
    """

    table: DataFrame
    small: bool
    has_multi: bool

    def side(self, df: DataFrame) -> DataFrame:
        """A relation derived from the phrases, broadcast if they were measured small."""
        return F.broadcast(df) if self.small else df


def query_phrases(queries: DataFrame) -> Phrases:
    asked = spread_small_scan(queries.select("qid", "query"), "qid")
    tokens = (
        asked.where(~is_blank(F.col("query")))
        .select("qid", F.explode(quoted_phrases(F.col("query"))).alias("word"))
        .select("qid", fts_tokens(F.col("word")).alias("tokens"))
        .where(F.size("tokens") > 0)
    )
    table = (
        tokens.withColumn("phrase", F.array_join("tokens", " "))
        .groupBy("qid", "phrase", "tokens")
        .agg(F.count("*").alias("weight"))
        .withColumn("n", F.size("tokens"))
    )
    rows, text, longest = table.agg(
        F.count("*"), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0)), F.max("n")
    ).first()
    size = rows * 80 + 2 * text
    return Phrases(table, size <= BROADCAST_BYTES, (longest or 1) > 1)


def tokenized(docs: DataFrame, *keep: str) -> DataFrame:
    """``(doc_id, tokens, dl)`` of documents ``(doc_id, text)``; ``keep`` names further columns to keep."""
    docs = spread_texts(docs.select("doc_id", "text"), "doc_id")
    tokens = docs.select("doc_id", *keep, fts_tokens(F.col("text")).alias("tokens"))
    return tokens.withColumn("dl", F.size("tokens").cast("long"))


def build_postings(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """``(doc_id, term, tf, positions, dl)``: one row per document and term.

    The list of positions belongs to one document, so it is bounded by its length.  With a number of
    buckets documents are dealt out by id first: grouping then shuffles nothing, and a table of so many
    buckets by ``doc_id`` gets one file a bucket.  Documents that were tokenised keep their tokens.
    """
    tokens = docs.select("doc_id", "tokens", "dl") if "tokens" in docs.columns else tokenized(docs)
    # An inner explode would have texts taken apart a second time, to drop empty ones before the shuffle.
    exploded = (tokens.repartition(buckets, "doc_id") if buckets else tokens).select(
        "doc_id", "dl", F.posexplode_outer("tokens").alias("pos", "term")
    )
    return (
        exploded.where(F.col("term").isNotNull()).groupBy("doc_id", "term", "dl")
        .agg(F.array_sort(F.collect_list("pos")).alias("positions"))
        .select("doc_id", "term", F.size("positions").cast("long").alias("tf"), "positions", "dl")
    )


def corpus_stats(doc_lengths: DataFrame) -> DataFrame:
    """One row ``(n_docs, avgdl)`` from ``(doc_id, dl)``."""
    return doc_lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def _anchored(table: DataFrame) -> DataFrame:
    """``(term, phrase, phrase_tokens, n, offset)``: each longer phrase under its longest token.

    Any token would do; long ones are rare, so fewer places have to be looked at.
    """
    multi = table.where(F.col("n") > 1).select("phrase", F.col("tokens").alias("phrase_tokens"), "n")
    sized = F.transform(
        "phrase_tokens", lambda t, i: F.struct((-F.length(t)).alias("l"), i.alias("offset"), t.alias("term"))
    )
    return (
        multi.distinct()
        .withColumn("anchor", F.array_min(sized))
        .select("anchor.term", "phrase", "phrase_tokens", "n", "anchor.offset")
    )


def _phrase_terms(table: DataFrame) -> DataFrame:
    """``(phrase, n, offset, term)``: every token of the phrases that hold several."""
    multi = table.where(F.col("n") > 1).select("phrase", "tokens", "n").distinct()
    return multi.select("phrase", "n", F.posexplode("tokens").alias("offset", "term"))


def phrase_frequencies(tokens: DataFrame, phrases: Phrases) -> DataFrame:
    """``(doc_id, dl, phrase, tf)`` straight from tokenised documents.

    Only tokens that occur in some query leave the scan.  Every document also
    yields one row of the empty phrase, so that the corpus statistics come out
    of the same pass over the text.
    """
    table = phrases.table
    single = table.where(F.col("n") == 1).select(F.col("phrase").alias("term"))
    single = single.union(table.sparkSession.sql("SELECT '' AS term")).distinct()
    with_marker = F.concat(F.array(F.lit("")), F.col("tokens"))
    one = (
        tokens.select("doc_id", "dl", F.explode(with_marker).alias("term"))
        .join(phrases.side(single), "term")
        .groupBy("doc_id", "dl", F.col("term").alias("phrase"))
        .agg(F.count("*").alias("tf"))
    )
    if not phrases.has_multi:
        return one
    here = F.slice(
        F.col("tokens"), F.greatest(F.col("pos") - F.col("offset"), F.lit(0)) + F.lit(1), F.col("n")
    )
    several = (
        tokens.select("doc_id", "dl", "tokens", F.posexplode("tokens").alias("pos", "term"))
        .join(phrases.side(_anchored(table)), "term")
        .where((F.col("pos") >= F.col("offset")) & (here == F.col("phrase_tokens")))
        .groupBy("doc_id", "dl", "phrase")
        .agg(F.count("*").alias("tf"))
    )
    return one.unionByName(several)


def indexed_phrase_frequencies(postings: DataFrame, phrases: Phrases) -> DataFrame:
    """``(doc_id, dl, phrase, tf)`` from stored postings.

    With postings bucketed by ``doc_id``, every later grouping holds ``doc_id``
    and needs no shuffle.
    """
    table = phrases.table
    single = table.where(F.col("n") == 1).select(F.col("phrase").alias("term")).distinct()
    one = postings.join(phrases.side(single), "term").select(
        "doc_id", "dl", F.col("term").alias("phrase"), "tf"
    )
    if not phrases.has_multi:
        return one
    # One group per document and phrase, with one entry per token of the phrase.
    parts = F.collect_list(F.transform("positions", lambda p: p - F.col("offset")))
    starts = F.aggregate(
        F.slice("parts", 2, F.size("parts")), F.element_at("parts", 1), lambda acc, x: F.array_intersect(acc, x)
    )
    several = (
        postings.join(phrases.side(_phrase_terms(table)), "term")
        .groupBy("doc_id", "dl", "phrase", "n")
        .agg(parts.alias("parts"))
        .where(F.size("parts") == F.col("n"))
        .select("doc_id", "dl", "phrase", F.size(starts).cast("long").alias("tf"))
        .where(F.col("tf") > 0)
    )
    return one.unionByName(several)


def scored(frequencies: DataFrame, stats: DataFrame, phrases: Phrases) -> DataFrame:
    """``(qid, doc_id, score)``: the sum of all phrase contributions, higher is better."""
    df = frequencies.groupBy("phrase").agg(F.count("*").cast("double").alias("df"))
    n_docs = stats.select("n_docs").scalar().cast("double")
    avgdl = stats.select("avgdl").scalar()
    idf = F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf) * F.col("weight")
    weighted = (
        phrases.table.select("qid", "phrase", "weight")
        .join(df, "phrase")
        .select("qid", "phrase", gain.alias("gain"))
    )
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    saturation = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
    return (
        frequencies.withColumn("sat", saturation)
        .join(phrases.side(weighted), "phrase")
        .groupBy("qid", "doc_id")
        .agg(F.sum(F.col("gain") * F.col("sat")).alias("score"))
    )


def ranked(scores: DataFrame, k: int) -> DataFrame:
    order = [F.desc(F.round("score", _SCORE_DIGITS)), F.asc("doc_id")]
    return top_k(scores, ["qid"], order, k).select("qid", "rank", "doc_id", "score")


def _numbered(phrases: Phrases) -> DataFrame:
    """``(phrase, term)``: distinct phrases with numbers, collected only if they were measured small."""
    held = sorted(r[0] for r in phrases.table.select("phrase").distinct().collect())
    return phrases.table.sparkSession.createDataFrame([(p, i) for i, p in enumerate(held)], "phrase string, term int")


def _by_document(frequencies: DataFrame, numbers: DataFrame) -> DataFrame:
    """``(doc_id, dl, terms, tf)``: one row per document; it is as long as the text at most."""
    entry = F.array_sort(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))))
    joined = frequencies.join(F.broadcast(numbers), "phrase", "left")
    return joined.groupBy("doc_id", "dl").agg(entry.alias("e")).select(
        "doc_id", "dl", F.col("e.term").alias("terms"), F.col("e.tf").alias("tf")
    )


def _best(documents: DataFrame, stats: DataFrame, numbers: DataFrame, phrases: Phrases, k: int) -> DataFrame:
    """Ranking of stored rows by document: sums never leave the task that holds the document."""
    n_docs, avgdl = stats.select("n_docs", "avgdl").first()
    frequent = documents.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    asked = phrases.table.select("qid", "phrase", "weight").join(F.broadcast(numbers), "phrase").join(frequent, "term")
    rows = asked.select(F.col("qid").cast("long").alias("qid"), "term", "weight", "df").toArrow()  # measured before
    qid, term, weight, df = (rows.column(c).to_numpy() for c in ("qid", "term", "weight", "df"))
    if not len(qid):
        return documents.sparkSession.createDataFrame([], "qid long, rank long, doc_id long, score double")
    idf = np.log((n_docs - df + 0.5) / (df + 0.5))
    gain = np.where(idf <= 0, IDF_FLOOR, idf) * weight
    weights = Weights.of(qid, term.astype(np.int64), gain, int(term.max()) + 1)

    def saturation(tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))

    # Documents come without their ids' type here; ids are long throughout.
    held = documents.where(F.size("terms") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("dl").cast("long").alias("dl"), "terms", "tf")
    return ranked(top_sums(held, weights, saturation, k, _SCORE_DIGITS), k)


def bm25_search(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(qid, rank, doc_id, score)`` for documents ``(doc_id, text)`` and queries ``(qid, query)``.

    Queries of a measured small size are held by every task, which scores its documents block by
    block; more queries than that meet the documents in joins.
    """
    phrases = query_phrases(queries)
    # One pass over the text; everything after reads the few rows that matter.
    frequencies = phrase_frequencies(tokenized(docs), phrases)
    if not phrases.small:
        found = checkpoint(frequencies)
        stats = corpus_stats(found.where(F.col("phrase") == ""))
        return ranked(scored(found.where(F.col("phrase") != ""), stats, phrases), k)
    numbers = _numbered(phrases)
    documents = checkpoint(_by_document(frequencies, numbers))
    return _best(documents, corpus_stats(documents), numbers, phrases, k)


def bm25_search_index(
    postings: DataFrame, doc_lengths: DataFrame, queries: DataFrame, k: int
) -> DataFrame:
    """The same ranking from stored postings and document lengths."""
    phrases = query_phrases(queries)
    frequencies = indexed_phrase_frequencies(postings, phrases)
    if not phrases.small:
        return ranked(scored(frequencies, corpus_stats(doc_lengths), phrases), k)
    numbers = _numbered(phrases)
    documents = checkpoint(_by_document(frequencies, numbers))
    return _best(documents, corpus_stats(doc_lengths), numbers, phrases, k)
