"""Registered queries of this package and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import (
    alignment, balltree, bottomk, decontam, licences, linededup, mixing, passages, quality, sanitise, topk, toxicity, warc,
)
from lodestone.llm.common import table
from lodestone.session import checkpoint

Query = Callable[[SparkSession, str], DataFrame]

# Vocabulary files of public tokenizers, installed on every worker.
TOKENIZERS = "/opt/tokenizers"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by a model of the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors nearest to every vector whose id is divisible by 20."""
    vectors = checkpoint(topk.integer_vectors(table(spark, sf_dir, "embeddings")))
    return topk.search(vectors, vectors.where("vec_id % 20 = 0"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents over 4-word shingles."""
    return bottomk.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers and disclosing terms of all documents."""
    return sanitise.report(sanitise.scan(table(spark, sf_dir, "documents")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read again."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, tags and expressions of all documents."""
    return licences.scan(table(spark, sf_dir, "documents")).drop("expressions")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in a mix of the sources by weight."""
    return mixing.taken(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without runs of lines that occur earlier."""
    done = linededup.without_repeats(table(spark, sf_dir, "documents"))
    return done.selectExpr("doc_id", "__lines AS n_lines", "__removed AS n_removed", "text")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document occurs in benchmark items, by windows of 13 words."""
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.judged(found).drop("spans")


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more of all documents that repeat one of an earlier document."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item by integer lexical scores."""
    return balltree.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a model of the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of a byte-level and a piece tokenizer in all documents."""
    return alignment.aligned_documents(
        table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
    )


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_topk": op2_topk,
    "op3_minhash": op3_minhash,
    "op4_pii": op4_pii,
    "op5_warc": op5_warc,
    "op6_licences": op6_licences,
    "op7_mixing": op7_mixing,
    "op8_line_dedup": op8_line_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_passages": op10_passages,
    "op11_ranked_search": op11_ranked_search,
    "op12_quality": op12_quality,
    "op13_alignment": op13_alignment,
}

SQL: dict[str, str] = {
    "op2_topk": """
        WITH v AS (
            SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
            GROUP BY vec_id),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
        r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
        b AS (SELECT h, max(page_id) AS best FROM p WHERE n >= 1000 GROUP BY h)
        SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
            CASE WHEN page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id < best THEN best END AS refers_to
        FROM p LEFT JOIN b ON p.h = b.h
    """,
    "op9_decontamination": """
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, n, w[i : i + n - 1] AS g
            FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(0, len(w) - least(13, len(w)) + 1) + 1)) AS i
                  FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM windows),
        places AS (
            SELECT doc_id, n, i, w[i : i + n - 1] AS g
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
        hits AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, g)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
            coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op11_ranked_search": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM documents),
        q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS t
            FROM benchmark WHERE item_id IS NOT NULL),
        totals AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
        tf AS (
            SELECT r, doc_id, n, t, count(*)::BIGINT AS tf
            FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d WHERE len(w) > 0)
            WHERE t IN (SELECT t FROM q) GROUP BY ALL),
        weights AS (
            SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
            FROM (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t), totals),
        scores AS (
            SELECT item_id, r, doc_id,
                sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
            FROM q JOIN tf USING (t) JOIN weights USING (t), totals WHERE doc_id IS NOT NULL GROUP BY item_id, r, doc_id),
        best AS (
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
            FROM scores WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM best WHERE rank <= 50
    """,
}
