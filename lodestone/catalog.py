"""The registered queries: every operator applied to whole tables of a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import (
    EmbeddingConfig, ExperimentConfig, IngestionConfig, LLMConfig, RetrievalConfig, VecGraphConfig,
)
from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import (
    bm25, chunking, costs, dataset, entities, graph, hybrid, knn, overlap, scoring,
    semantic_dedup, triples, vecgraph,
)
from lodestone.plans.agent import Agent
from lodestone.plans.memories import Memory, OverlapMemory, build_memory
from lodestone.plugins import Models, offline_models
from lodestone.session import checkpoint, checkpoint_dir
from lodestone.sources.store import TableStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CHUNK_SIZE, CHUNK_OVERLAP = 300, 50
TOP_K = 5
# The test vectors are nearly orthogonal, so thresholds lie lower than in production.
NEAR = 0.35
VECTOR_CUTOFF = 0.68


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- inputs derived from the tables -----------------------------------------


def _documents(spark, folder):
    return _table(spark, folder, "documents").select("doc_id", "text")


def _benchmark_queries(spark, folder):
    return _table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _label_queries(spark, folder):
    """The mean vector of every label, as a query."""
    parts = _table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
    means = parts.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("d", "x")))
    vec = F.transform(ordered, lambda p: p["x"])
    return means.groupBy(F.col("label").cast("long").alias("qid")).agg(vec.alias("vec"))


def _place_edges(spark, folder):
    """Customers and suppliers located in nations that are part of regions."""
    nation = _table(spark, folder, "nation")
    region = _table(spark, folder, "region")
    supplier = _table(spark, folder, "supplier")
    customer = _table(spark, folder, "customer")
    named = nation.select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("object"))
    parts = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        (F.col("n_nationkey").cast("long") * 4).alias("eid"),
        F.col("n_name").alias("subject"), F.lit("part_of").alias("predicate"), F.col("r_name").alias("object"),
    )
    sup = supplier.join(named, F.col("s_nationkey") == F.col("nk")).select(
        (F.col("s_suppkey") * 4 + 1).alias("eid"),
        F.col("s_name").alias("subject"), F.lit("located_in").alias("predicate"), "object",
    )
    cust = customer.join(named, F.col("c_nationkey") == F.col("nk")).select(
        (F.col("c_custkey") * 4 + 2).alias("eid"),
        F.col("c_name").alias("subject"), F.lit("located_in").alias("predicate"), "object",
    )
    return parts.unionByName(sup).unionByName(cust)


def _place_queries(spark, folder):
    question = F.concat(F.lit("where is "), F.col("s_name"), F.lit(" at"))
    return _table(spark, folder, "supplier").select(F.col("s_suppkey").alias("qid"), question.alias("query"))


def _replies(spark, folder):
    """Extraction replies made of events: broken ones, objects, arrays with valid and invalid items."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    user = F.concat(F.lit("User "), F.col("user_id").cast("string"))
    item = F.concat(
        F.lit('{"subject":'), quoted(user), F.lit(',"predicate":'), quoted(F.col("event_type")),
        F.lit(',"description":'), quoted(F.concat(F.lit(" Did "), F.col("event_type"), F.lit(" "))),
        F.lit(',"object":'),
    )
    text_object = F.concat(item, quoted(F.col("event_type")), F.lit("}"))
    number_object = F.concat(item, F.col("user_id").cast("string"), F.lit("}"))
    array = F.concat(F.lit("["), F.col("props"), F.lit(", "), text_object, F.lit(", "), number_object, F.lit("]"))
    reply = (
        F.when(F.col("event_type") == "error", F.concat(array, F.lit(" trailing")))
        .when(F.col("event_type") == "view", text_object)
        .otherwise(array)
    )
    return _table(spark, folder, "events").select(F.col("event_id").alias("doc_id"), reply.alias("reply"))


def _calls(spark, folder):
    """The event stream read as a log of model calls."""
    e = _table(spark, folder, "events")
    tokens = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        (F.col("event_type") != "error").alias("ok"),
        F.col("ts"),
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        F.when(F.col("event_type") == "view", "retrieval_overhead")
        .when(F.col("event_type") == "click", "agent_reasoning")
        .when(F.col("event_type") == "error", "ingest").alias("phase"),
        F.when(F.col("event_type") == "view", "vector_embed").otherwise("langgraph_node").alias("actor"),
        F.col("event_type").alias("variant_name"),
        F.lit("provider/model").alias("model"),
        tokens.alias("prompt_tokens"),
        F.floor("value").cast("long").alias("completion_tokens"),
        F.lit(None).cast("long").alias("reasoning_tokens"),
        F.when(F.col("value") > 10, tokens + 1).alias("total_tokens"),
        (F.col("value") / 16).alias("seconds"),
        F.lit(None).cast("string").alias("error"),
        F.col("event_id"),
    )


def _label_triplets(spark, folder):
    """Vectors as triplets between their label, a hub, and an item of their own."""
    e = _table(spark, folder, "embeddings")
    item = F.col("vec_id").cast("string")
    label = F.col("label").cast("string")
    return e.select(
        F.col("vec_id").alias("trip_id"),
        F.concat(F.lit("Topic "), label).alias("subject"),
        F.concat(F.lit("covers item of topic "), label).alias("description"),
        F.concat(F.lit("Item "), item).alias("object"),
        F.concat(F.lit("topic "), label).alias("subject_key"),
        F.concat(F.lit("item "), item).alias("object_key"),
        "embedding",
    )


# ---- full-text and overlap retrieval ----------------------------------------


@_query
def bm25_topk(spark, folder):
    hits = bm25.bm25_search(_documents(spark, folder), _benchmark_queries(spark, folder), TOP_K)
    return hits.select("qid", "rank", "doc_id", F.round("score", 6).alias("score"))


@_query
def bm25_phrases(spark, folder):
    """Every line of a benchmark text as one phrase of adjacent tokens."""
    queries = _benchmark_queries(spark, folder).withColumn("query", F.replace("query", F.lit(" "), F.lit("/")))
    hits = bm25.bm25_search(_documents(spark, folder), queries, TOP_K)
    return hits.select("qid", "rank", "doc_id", F.round("score", 6).alias("score"))


@_query
def bm25_index_topk(spark, folder):
    """The ranking from postings instead of texts."""
    docs = _documents(spark, folder)
    postings = checkpoint(bm25.build_postings(docs))
    lengths = bm25.tokenized(docs).select("doc_id", "dl")
    hits = bm25.bm25_search_index(postings, lengths, _benchmark_queries(spark, folder), TOP_K)
    return hits.select("qid", "rank", "doc_id", F.round("score", 6).alias("score"))


@_query
def term_statistics(spark, folder):
    """Document and collection frequency of every term."""
    # An inner explode would have texts taken apart a second time, to drop empty ones before the shuffle.
    exploded = bm25.tokenized(_documents(spark, folder)).select("doc_id", F.explode_outer("tokens").alias("term"))
    per_doc = exploded.where(F.col("term").isNotNull()).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return per_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@_query
def corpus_statistics(spark, folder):
    stats = bm25.corpus_stats(bm25.tokenized(_documents(spark, folder)))
    return stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@_query
def query_phrases(spark, folder):
    """Sanitised full-text queries with the repetition of each phrase."""
    turns = _table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("query")
    )
    return bm25.query_phrases(turns).table.select("qid", "phrase", "weight")


@_query
def overlap_topk(spark, folder):
    return overlap.overlap_search(_documents(spark, folder), _benchmark_queries(spark, folder), TOP_K)


@_query
def context_assembly(spark, folder):
    """Retrieved passages of each query joined into the prompt for the answering model."""
    docs, queries = _documents(spark, folder), _benchmark_queries(spark, folder)
    hits = overlap.overlap_search(docs, queries, TOP_K)
    passages = hits.join(docs, "doc_id").groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("p")
    )
    joined = queries.join(passages, "qid", "left")
    context = F.coalesce(F.transform("p", lambda x: x["text"]), F.array().cast("array<string>"))
    prompt = T.user_prompt(T.context_block(context), F.col("query"))
    return joined.select("qid", F.size(context).alias("passages"), T.text_md5(prompt).alias("prompt_md5"))


# ---- chunks and documents ---------------------------------------------------


@_query
def chunk_words(spark, folder):
    chunks = chunking.chunk_documents(_documents(spark, folder), CHUNK_SIZE, CHUNK_OVERLAP)
    return chunks.select("doc_id", "chunk_no", "chunk")


@_query
def chunk_md5(spark, folder):
    chunks = chunking.chunk_documents(_documents(spark, folder), CHUNK_SIZE, CHUNK_OVERLAP)
    return chunks.groupBy("source_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


@_query
def clean_documents(spark, folder):
    """Stripped, non-blank documents; also the size of the store they make."""
    docs = chunking.clean_documents(_documents(spark, folder))
    return docs.agg(F.count("*").alias("store_size"), F.sum(F.length("text")).alias("chars"))


@_query
def doc_dedup_first(spark, folder):
    docs = _documents(spark, folder)
    return docs.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text")


@_query
def extract_paragraphs(spark, folder):
    """Paragraphs ``title: sentences`` of the documents, each once."""
    docs = _table(spark, folder, "documents")
    context = F.struct(
        F.array("source").alias("title"), F.array(F.split("text", "\n")).alias("sentences")
    )
    texts = dataset.distinct_paragraphs(docs.select(F.col("doc_id").alias("idx"), context.alias("context")))
    return texts.select(F.col("idx").alias("doc_id"), "text")


@_query
def extract_questions(spark, folder):
    turns = _table(spark, folder, "conversations")
    samples = turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("idx"),
        F.col("text").alias("question"),
        F.when(F.col("role") == "assistant", F.col("text")).alias("answer"),
        F.when(F.col("role") != "system", F.col("role")).alias("type"),
        F.lit(None).cast("string").alias("level"),
    )
    asked = dataset.extract_questions(samples)
    return asked.select("idx", "type", "level", "question", dataset.expected_answer(asked).alias("expected"))


@_query
def stratified_sample(spark, folder):
    """A sample with more strata than the rounding can serve, so the surplus is cut."""
    docs = _table(spark, folder, "documents")
    return dataset.stratified_sample(docs, ["lang", "source"], 100, order="doc_id")


@_query
def stratified_sample_padded(spark, folder):
    """A sample whose quotas round down, so it is filled up."""
    docs = _table(spark, folder, "documents")
    return dataset.stratified_sample(docs, ["lang"], 7, order="doc_id")


@_query
def strata_counts(spark, folder):
    return dataset.strata_counts(_table(spark, folder, "documents"), ["lang", "source"])


@_query
def counts_per_key(spark, folder):
    return dataset.counts_per_key(_table(spark, folder, "labels"), ["quality", "toxic"])


# ---- vectors ----------------------------------------------------------------


def _vectors(spark, folder):
    return _table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@_query
def vector_topk_cutoff(spark, folder):
    corpus = _vectors(spark, folder).withColumnRenamed("embedding", "vec")
    hits = knn.vector_search(corpus, _label_queries(spark, folder), 20, VECTOR_CUTOFF)
    return hits.select("qid", "rank", "id", F.round("sim", 6).alias("sim"))


@_query
def vector_knn_join(spark, folder):
    """The nearest neighbours of every vector."""
    corpus = _vectors(spark, folder).withColumnRenamed("embedding", "vec")
    hits = knn.knn_search(corpus, corpus.withColumnRenamed("id", "qid"), TOP_K)
    return hits.select("qid", "rank", "id", F.round("cos", 6).alias("cos"))


@_query
def label_cohesion(spark, folder):
    """Similarity of every vector to the mean of its label."""
    e = _table(spark, folder, "embeddings")
    means = checkpoint(_label_queries(spark, folder))
    joined = e.join(means, F.col("label").cast("long") == F.col("qid"))
    cos = V.cosine(V.l2_normalize(F.col("embedding")), F.col("vec"))
    return joined.select("vec_id", F.round(V.similarity_from_cosine(cos), 6).alias("sim"))


@_query
def semantic_dedup_kept(spark, folder):
    kept = semantic_dedup.semantic_dedup(_vectors(spark, folder), NEAR)
    return kept.where("kept").select("id")


@_query
def entity_candidates(spark, folder):
    found = entities.entity_candidates(_vectors(spark, folder), TOP_K, NEAR)
    return found.select("id", "rank", "cand", F.round("sim", 6).alias("sim"))


@_query
def entity_resolution(spark, folder):
    """Sequential merging of names, with a selector that takes the nearest candidate."""
    names = _vectors(spark, folder).withColumn("name", F.concat(F.lit("name "), F.col("id").cast("string")))
    return entities.resolve_entities(names, entities.always_nearest, TOP_K, NEAR)


@_query
def choice_replies(spark, folder):
    """Replies of a selector read as a choice among five: numbers in and out of range, signs, words, blanks."""
    number = F.col("user_id") % 8
    said = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("  "), number.cast("string"), F.lit("\n")))
        .when(F.col("event_type") == "click", F.concat(F.lit("+"), number.cast("string")))
        .when(F.col("event_type") == "error", F.concat(number.cast("string"), F.lit(".")))
        .otherwise(F.concat(F.lit("-"), number.cast("string")))
    )
    replies = _table(spark, folder, "events").select("event_id", said.alias("reply"))
    return replies.select("event_id", T.choice_index(F.col("reply"), F.lit(5)).cast("long").alias("choice"))


@_query
def alias_resolve(spark, folder):
    """Part names, brands and types looked up among entities named after parts."""
    part = _table(spark, folder, "part")
    known = part.select(T.norm_name(F.col("p_name")).alias("entity_key")).distinct()
    alias_rows = part.groupBy("p_brand").agg(F.min("p_name").alias("name"), F.min("p_partkey").alias("id")).select(
        F.col("id").alias("entity_id"), T.norm_name(F.col("name")).alias("entity_key"), F.array("p_brand").alias("aliases")
    )
    names = part.select(
        "p_partkey",
        F.explode(F.array(F.concat(F.lit("  "), F.upper("p_name")), F.col("p_brand"), F.col("p_type"))).alias("name"),
    )
    return entities.resolve_names(names, known, entities.alias_map(alias_rows)).select(
        "p_partkey", "name", "entity_key"
    )


@_query
def knn_1hop(spark, folder):
    return vecgraph.vecgraph_search(_label_triplets(spark, folder), _label_queries(spark, folder), TOP_K)


@_query
def hybrid_context(spark, folder):
    """One context per query from nearest entities and nearest relations."""
    t = _label_triplets(spark, folder)
    ents = t.select(F.col("trip_id").alias("id"), F.col("object").alias("name"), F.col("embedding").alias("vec"))
    rels = t.select(
        F.col("trip_id").alias("eid"), "subject", F.lit("covers_item").alias("predicate"), "object",
        F.reverse("embedding").alias("vec"),
    )
    return hybrid.hybrid_search(ents, rels, _label_queries(spark, folder), TOP_K)


# ---- graph and triples ------------------------------------------------------


@_query
def graph_bfs_2hop(spark, folder):
    return graph.graph_search(_place_edges(spark, folder), _place_queries(spark, folder), TOP_K)


@_query
def graph_size(spark, folder):
    return graph.graph_size(_place_edges(spark, folder))


@_query
def triple_exact_dedup(spark, folder):
    """Repeated shipping relations between suppliers and parts, first occurrence kept."""
    lines = _table(spark, folder, "lineitem")
    edges = lines.select(
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("eid"),
        F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("subject"),
        F.concat(F.lit("ships_"), F.col("l_returnflag")).alias("predicate"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("object"),
    )
    return triples.dedup_edges(edges)


@_query
def edge_replies(spark, folder):
    """Edges in extraction replies: three non-blank strings each."""
    return triples.parse_edges(_replies(spark, folder))


@_query
def triplet_replies(spark, folder):
    """Described triplets in extraction replies: four truthy values each."""
    return triples.parse_triplets(_replies(spark, folder), "doc_id")


@_query
def triplet_dedup(spark, folder):
    """Triplets of all replies, one per subject, description and object."""
    parsed = triples.parse_triplets(_replies(spark, folder), "doc_id")
    keyed = parsed.select(
        (F.col("doc_id") * 8 + F.col("item_no")).alias("ord"), "subject", "description", "object",
        T.norm_name(F.col("subject")).alias("subject_key"), T.norm_name(F.col("object")).alias("object_key"),
    )
    text = T.triplet_text(F.col("subject"), F.col("description"), F.col("object"))
    return triples.dedup_triplets(keyed).select("ord", text.alias("text"))


# ---- cost and quality -------------------------------------------------------


@_query
def telemetry_cost(spark, folder):
    records = costs.call_records(_calls(spark, folder))
    total = costs.cost_by(records, ["variant_name", "phase", "actor"])
    return total.withColumn("latency_ms", F.round("latency_ms", 2))


@_query
def untagged_calls(spark, folder):
    records = costs.untagged_calls(costs.call_records(_calls(spark, folder)))
    return records.groupBy("model", "variant_name").agg(F.count("*").alias("n"))


@_query
def call_index(spark, folder):
    """Successful calls of each run, numbered in time order."""
    calls = _calls(spark, folder)
    records = calls.select(
        F.when(F.col("ok"), costs.CALL).otherwise(costs.FAILURE).alias("event"), "run_id", "ts", "event_id"
    )
    return costs.call_index(records, ["run_id"], ["ts", "event_id"]).select("run_id", "event_id", "call_index")


@_query
def results_join_cost(spark, folder):
    """Question turns with the cost of the run they belong to."""
    turns = _table(spark, folder, "conversations")
    results = turns.where(F.col("role") == "user").select(
        F.concat(F.lit("run-"), F.col("conv_id").cast("string")).alias("run_id"), "turn"
    )
    joined = costs.results_with_cost(results, costs.call_records(_calls(spark, folder)))
    return joined.withColumn("latency_ms", F.round("latency_ms", 2))


def _answer_pairs(spark, folder):
    """The assistant turn that follows a user turn, as an answer to be scored against it."""
    turns = _table(spark, folder, "conversations")
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("expected")
    )
    given = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(given, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "answer", "expected"
    )


@_query
def qa_em_f1(spark, folder):
    scores = scoring.score_answers(_answer_pairs(spark, folder))
    return scores.select("id", "exact_match", F.round("f1", 6).alias("f1"))


@_query
def qa_summary(spark, folder):
    summary = scoring.score_summary(scoring.score_answers(_answer_pairs(spark, folder)))
    return summary.select("questions", F.round("em", 6).alias("em"), F.round("f1", 6).alias("f1"))


@_query
def qa_answers(spark, folder):
    """Benchmark texts answered from the documents: retrieve, assemble the prompt, reason."""
    config = ExperimentConfig(
        variant_name="registered", agent_type="dummy", data_file="documents",
        llm=LLMConfig("offline/first-line"), embedding=EmbeddingConfig("offline/hashing"),
        retrieval=RetrievalConfig(top_k=TOP_K), ingestion=IngestionConfig(CHUNK_SIZE, CHUNK_OVERLAP),
    )
    memory = OverlapMemory(spark, config, offline_models(), _store(spark))
    memory.docs = lambda: _documents(spark, folder)
    asked = _benchmark_queries(spark, folder).select(
        "qid", F.col("query").alias("question"), F.lit("").alias("expected")
    )
    results = Agent(memory).answer_many(asked)
    return results.select(
        "qid", "variant_name", "agent_type", "question", "expected", "answer",
        F.size("context_used").alias("passages"), F.array_join("steps_taken", ",").alias("steps"), "backend_name",
    )


# ---- backends over their stores ---------------------------------------------


def _store(spark: SparkSession) -> TableStore:
    """An empty store in the shared folder."""
    return TableStore(spark, f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")


def _memory(spark: SparkSession, agent_type: str, models: Models, cutoff: float = 0.7) -> Memory:
    """An empty backend with a store of its own."""
    config = ExperimentConfig(
        variant_name="registered", agent_type=agent_type, data_file="documents",
        llm=LLMConfig("offline/reader"), embedding=EmbeddingConfig("offline/letters"),
        retrieval=RetrievalConfig(TOP_K, cutoff), ingestion=IngestionConfig(CHUNK_SIZE, CHUNK_OVERLAP),
        vecgraph=VecGraphConfig(dedup_threshold=1.0, entity_lm_lower=0.5, entity_lm_top_k=TOP_K),
    )
    return build_memory(spark, config, models, _store(spark))


def _letters(text):
    """How often each letter occurs in a text: an embedding other engines can repeat."""
    low = F.lower(text)
    count = lambda c: (F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("float")
    return F.array(*[count(c) for c in "abcdefghijklmnopqrstuvwxyz"])


def _told_and_asked(memory: Memory, spark: SparkSession, folder: str) -> DataFrame:
    """Hits after all documents and, as a later fact, the first benchmark text were taken in."""
    memory.ingest_documents(_documents(spark, folder))
    fact = _table(spark, folder, "benchmark").agg(F.min_by("text", "item_id")).first()[0]
    memory.update_fact(fact)
    hits = memory.search_many(_benchmark_queries(spark, folder))
    return hits.select("qid", "rank", T.text_md5(F.col("text")).alias("text_md5"))


@_query
def bm25_store_search(spark, folder):
    """Full-text search over stored postings, with a fact added after ingestion."""
    return _told_and_asked(_memory(spark, "bm25", offline_models()), spark, folder)


@_query
def vector_store_search(spark, folder):
    """Vector search over stored chunks, with a fact added after ingestion."""
    return _told_and_asked(_memory(spark, "vector", Models(embed=_letters), 0.97), spark, folder)


@_query
def pipeline_cost(spark, folder):
    """Model calls of a run over described relations: extraction, selection, embedding and search."""
    nation = _table(spark, folder, "nation")
    placed = _table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    facts = placed.select(
        F.col("s_suppkey").alias("doc_id"), F.concat("s_name", F.lit(" is located in "), "n_name", F.lit(".")).alias("text")
    )
    # Names of one kind are alike, those of different kinds are not.
    kind = lambda text: F.when(text.startswith("Supplier"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(
        F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>")
    memory = _memory(spark, "vecgraph", Models(embed=kind))
    memory.ingest_documents(facts)
    memory.search_many(
        nation.select(F.col("n_nationkey").alias("qid"), F.concat(F.lit("what is located in "), "n_name").alias("query"))
    )
    records = reduce(DataFrame.unionByName, memory.calls)
    return costs.cost_by(records, ["phase", "actor", "model"]).drop("latency_ms")
