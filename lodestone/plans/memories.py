"""The retrieval backends: ingest documents, answer batches of queries, learn single facts.

All state lies in the tables of a store, so ingestion and question answering may
run in different applications.  ``search_many`` is the set-oriented operation;
``search`` asks it a single question.
"""

from __future__ import annotations

import tempfile
from abc import ABC, abstractmethod
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import ExperimentConfig
from lodestone.functions.text import (
    edge_text, is_blank, norm_name, numbered_block, strip_ws, text_md5, triplet_embed_text,
)
from lodestone.operators import bm25, costs, entities, graph, hybrid, knn, overlap, triples, vecgraph
from lodestone.operators.chunking import chunk_documents, clean_documents
from lodestone.operators.ranking import running_number
from lodestone.operators.semantic_dedup import semantic_dedup
from lodestone.plugins import Models, choice_prompt
from lodestone.session import checkpoint
from lodestone.sources.store import TableStore

_DOCS = "doc_id long, text string"
_HITS = "qid long, rank long, text string"
# Stream batches taken in so far.
_BATCHES = "batches"


class Memory(ABC):
    """Common part of all backends."""

    name: str
    tables: tuple[str, ...]

    def __init__(
        self, spark: SparkSession, config: ExperimentConfig, models: Models,
        store: TableStore | None = None, calls: list[DataFrame] | None = None,
    ) -> None:
        """``store`` holds the state, by default one at ``memory_path``.  ``calls`` is a list of noted model
        calls that several backends of one session may share.
        """
        self.spark, self.config, self.models = spark, config, models
        if store is None:
            if not config.memory_path and not spark.sparkContext.master.startswith("local"):
                raise ValueError("memory_path must name a folder all executors share")
            store = TableStore(spark, config.memory_path or tempfile.mkdtemp(prefix=f"lodestone-{self.name}-"))
        self.store = store
        # Records of model calls not yet written to the log.
        self.calls: list[DataFrame] = [] if calls is None else calls

    @property
    def k(self) -> int:
        return self.config.retrieval.top_k

    def _as_documents(self, documents: DataFrame | Sequence[str]) -> DataFrame:
        if isinstance(documents, DataFrame):
            return documents.select(F.col("doc_id").cast("long"), "text")
        return self.spark.createDataFrame(list(enumerate(documents)), _DOCS)

    def ingest_documents(self, documents: DataFrame | Sequence[str]) -> None:
        """Take in documents ``(doc_id, text)``, or a list of texts; blank ones are skipped."""
        self._ingest(self._as_documents(documents), "ingest", "ingest", chunked=True)

    def ingest_batch(self, documents: DataFrame, source: str, batch_id: int) -> bool:
        """Take in one batch of a stream unless it was taken before; tells whether it was.

        A batch is noted under its source and number once its rows are stored.  If a job dies in between,
        the replay appends again what had been appended, so rows are also compared with the stored ones
        by the backends that keep each fact once.
        """
        taken = self.store.read(_BATCHES, "source string, batch_id long")
        if not taken.where((F.col("source") == source) & (F.col("batch_id") == batch_id)).isEmpty():
            return False
        self.ingest_documents(documents)
        self.store.append(_BATCHES, self.spark.createDataFrame([(source, batch_id)], "source string, batch_id long").coalesce(1))
        return True

    def update_fact(self, fact: str) -> None:
        """Take in a single statement, findable at once."""
        if fact.strip():
            self._ingest(self._as_documents([fact]), "agent_reasoning", "update_fact", chunked=False)

    def search_many(self, queries: DataFrame) -> DataFrame:
        """``(qid, rank, text)`` for queries ``(qid, query)``; blank queries find nothing."""
        asked = queries.where(~is_blank(F.col("query"))).select(F.col("qid").cast("long"), "query")
        return self._search(asked).select(F.col("qid").cast("long"), F.col("rank").cast("long"), "text")

    def search(self, query: str) -> list[str]:
        hits = self.search_many(self.spark.createDataFrame([(0, query)], "qid long, query string"))
        return [row.text for row in hits.orderBy("rank").collect()]

    def reset(self) -> None:
        self.store.drop(*self.tables, _BATCHES)
        self.calls.clear()

    @property
    @abstractmethod
    def store_size(self) -> int: ...

    @abstractmethod
    def _ingest(self, docs: DataFrame, phase: str, run_id: str, chunked: bool) -> None: ...

    @abstractmethod
    def _search(self, queries: DataFrame) -> DataFrame: ...

    # ---- shared helpers ----

    def _after(self, table: DataFrame, column: str) -> int:
        """First free number of an id column."""
        last = table.agg(F.max(column)).first()[0]
        return 0 if last is None else int(last) + 1

    def _numbered_behind(self, stored: DataFrame, rows: DataFrame, order: list[str], column: str) -> DataFrame:
        """``rows`` numbered in their order behind the ids stored so far, whatever their own ids are."""
        numbered = running_number(rows, [], order, name=column)
        return numbered.withColumn(column, F.col(column) + F.lit(self._after(stored, column) - 1))

    def _log(self, replies: DataFrame, column: str, phase: str, actor: str, run_id: Column, model: str | None = None) -> None:
        """Note the calls behind a column of replies, by default of the language model."""
        r = F.col(column)
        calls = replies.select(
            r["error"].isNull().alias("ok"),
            # The time of noting; a column of the current time would be that of the flush.
            F.lit(datetime.now(timezone.utc)).alias("ts"),
            run_id.alias("run_id"),
            F.lit(phase).alias("phase"),
            F.lit(actor).alias("actor"),
            F.lit(self.config.variant_name).alias("variant_name"),
            F.lit(model or self.config.llm.model).alias("model"),
            r["prompt_tokens"].alias("prompt_tokens"),
            r["completion_tokens"].alias("completion_tokens"),
            r["reasoning_tokens"].alias("reasoning_tokens"),
            r["total_tokens"].alias("total_tokens"),
            r["seconds"].alias("seconds"),
            r["error"].alias("error"),
        )
        self.calls.append(costs.call_records(calls))

    def _log_embedding(self, texts: DataFrame, text: Column, phase: str, run_id: str) -> None:
        """Note one embedding call per text of a batch that was embedded."""
        words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")
        reply = F.struct(
            words.alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"),
            F.lit(0).cast("long").alias("reasoning_tokens"), words.alias("total_tokens"),
            F.lit(0.0).alias("seconds"), F.lit(None).cast("string").alias("error"),
        )
        self._log(texts.select(reply.alias("r")), "r", phase, "vector_embed", F.lit(run_id), self.config.embedding.model)

    def _texts(self, hits: DataFrame, table: DataFrame, key: str, text: Column | str) -> DataFrame:
        """Texts of hits.  The hits are written out, so that the join sees how few they are."""
        return checkpoint(hits).join(table.withColumn("text", F.col(text) if isinstance(text, str) else text), key)


class _PassageMemory(Memory):
    """Backends that keep whole documents."""

    tables = ("docs",)

    def docs(self) -> DataFrame:
        return self.store.read("docs", _DOCS)

    def _numbered(self, docs: DataFrame) -> DataFrame:
        fresh = clean_documents(docs).withColumnRenamed("doc_id", "__place")
        return self._numbered_behind(self.docs(), fresh, ["__place", "text"], "doc_id").select("doc_id", "text")

    def _ingest(self, docs: DataFrame, phase: str, run_id: str, chunked: bool) -> None:
        self.store.append("docs", self._numbered(docs))

    @property
    def store_size(self) -> int:
        return self.docs().count()


class OverlapMemory(_PassageMemory):
    """Passages ranked by the query words they contain."""

    name = "dummy"

    def _search(self, queries: DataFrame) -> DataFrame:
        return self._texts(overlap.overlap_search(self.docs(), queries, self.k), self.docs(), "doc_id", "text")


class Bm25Memory(_PassageMemory):
    """Passages ranked by BM25 over stored postings."""

    name = "bm25"
    tables = ("docs", "lengths", "postings")

    # Buckets by document: grouping by document and term, by document and phrase or by
    # document and query then needs no shuffle, and a frequent term is spread evenly.
    _postings = (
        "postings", "doc_id bigint, term string, tf bigint, positions array<int>, dl bigint", "doc_id", "term"
    )

    def postings(self) -> DataFrame:
        return self.store.read_bucketed(*self._postings)

    def lengths(self) -> DataFrame:
        return self.store.read("lengths", "doc_id long, dl long")

    def _ingest(self, docs: DataFrame, phase: str, run_id: str, chunked: bool) -> None:
        # Pinned first, as the numbers depend on what is stored already.
        fresh = checkpoint(bm25.tokenized(self._numbered(docs), "text"))
        name, *layout = self._postings
        self.store.append_bucketed(name, bm25.build_postings(fresh, self.store.buckets(name)), *layout)
        self.store.append("lengths", fresh.select("doc_id", "dl"))
        self.store.append("docs", fresh.select("doc_id", "text"))

    def _search(self, queries: DataFrame) -> DataFrame:
        hits = bm25.bm25_search_index(self.postings(), self.lengths(), queries, self.k)
        return self._texts(hits, self.docs(), "doc_id", "text")


class VectorMemory(Memory):
    """Chunks ranked by cosine similarity, with a cutoff."""

    name = "vector"
    tables = ("chunks",)

    def chunks(self) -> DataFrame:
        return self.store.read("chunks", "chunk_id long, chunk string, embedding array<float>")

    def _cut(self, docs: DataFrame, chunked: bool) -> DataFrame:
        """``(chunk_id, chunk)``; a fact stays whole."""
        if chunked:
            cut = self.config.ingestion
            pieces = chunk_documents(docs, cut.chunk_size, cut.chunk_overlap)
        else:
            pieces = clean_documents(docs).select("doc_id", F.lit(0).alias("chunk_no"), F.col("text").alias("chunk"))
        pieces = pieces.select("doc_id", "chunk_no", "chunk")
        numbered = self._numbered_behind(self.chunks(), pieces, ["doc_id", "chunk_no", "chunk"], "chunk_id")
        return numbered.select("chunk_id", "chunk")

    def _ingest(self, docs: DataFrame, phase: str, run_id: str, chunked: bool) -> None:
        pieces = self._cut(docs, chunked)
        self.store.append("chunks", pieces.withColumn("embedding", self.models.embed(F.col("chunk"))))

    def _search(self, queries: DataFrame) -> DataFrame:
        asked = checkpoint(queries.select("qid", self.models.embed(F.col("query")).alias("vec")))
        corpus = self.chunks().select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vec"))
        hits = knn.vector_search(corpus, asked, self.k, self.config.retrieval.similarity_cutoff)
        return self._texts(hits.withColumnRenamed("id", "chunk_id"), self.chunks(), "chunk_id", "chunk")

    @property
    def store_size(self) -> int:
        return self.chunks().count()


class GraphMemory(Memory):
    """A graph of extracted relations, searched over two hops."""

    name = "graph"
    tables = ("edges",)
    _schema = "eid long, subject string, predicate string, object string"

    def edges(self) -> DataFrame:
        return self.store.read("edges", self._schema)

    def _new_edges(self, docs: DataFrame, phase: str, run_id: str) -> DataFrame:
        """Edges of the documents, numbered behind the stored ones."""
        asked = docs.where(~is_blank(F.col("text")))
        replies = checkpoint(asked.select("doc_id", self.models.triples(F.col("text")).alias("r")))
        self._log(replies, "r", phase, "graph_extract", F.lit(run_id))
        found = triples.parse_edges(replies.select("doc_id", F.col("r.reply").alias("reply")))
        order = ["doc_id", "item_no", "subject", "predicate", "object"]
        return self._numbered_behind(self.edges(), found, order, "eid").select("eid", "subject", "predicate", "object")

    def _ingest(self, docs: DataFrame, phase: str, run_id: str, chunked: bool) -> None:
        first = triples.dedup_edges(self._new_edges(docs, phase, run_id))
        known = self.edges().select("subject", "predicate", "object")
        self.store.append("edges", first.join(known, ["subject", "predicate", "object"], "left_anti"))

    def _search(self, queries: DataFrame) -> DataFrame:
        return graph.graph_search(self.edges(), queries, self.k)

    @property
    def node_count(self) -> int:
        return graph.graph_nodes(self.edges()).count()

    @property
    def edge_count(self) -> int:
        return self.edges().count()

    store_size = edge_count


class HybridMemory(GraphMemory):
    """Nearest entities and nearest relations together, as one context text."""

    name = "lightrag"
    tables = ("edges", "entity_vectors", "edge_vectors")

    def _ingest(self, docs: DataFrame, phase: str, run_id: str, chunked: bool) -> None:
        super()._ingest(docs, phase, run_id, chunked)
        known = self._entity_vectors()
        named = graph.graph_nodes(self.edges()).withColumnRenamed("node", "name")
        fresh = named.join(known.select("name"), "name", "left_anti")
        numbered = running_number(fresh, [], ["name"], name="id").withColumn(
            "id", F.col("id") + F.lit(self._after(known, "id"))
        )
        named = checkpoint(numbered.select("id", "name", self.models.embed(F.col("name")).alias("vec")))
        self._log_embedding(named, F.col("name"), phase, run_id)
        self.store.append("entity_vectors", named)
        todo = self.edges().join(self._edge_vectors().select("eid"), "eid", "left_anti")
        text = edge_text(F.col("subject"), F.col("predicate"), F.col("object"))
        told = checkpoint(todo.select("eid", text.alias("text"), self.models.embed(text).alias("vec")))
        self._log_embedding(told, F.col("text"), phase, run_id)
        self.store.append("edge_vectors", told.select("eid", "vec"))

    def _entity_vectors(self) -> DataFrame:
        return self.store.read("entity_vectors", "id long, name string, vec array<float>")

    def _edge_vectors(self) -> DataFrame:
        return self.store.read("edge_vectors", "eid long, vec array<float>")

    def _search(self, queries: DataFrame) -> DataFrame:
        asked = checkpoint(queries.select("qid", "query", self.models.embed(F.col("query")).alias("vec")))
        self._log_embedding(asked, F.col("query"), "retrieval_overhead", "search")
        relations = self.edges().join(self._edge_vectors(), "eid")
        found = hybrid.hybrid_search(self._entity_vectors(), relations, asked.select("qid", "vec"), self.k)
        return found.select("qid", F.lit(1).alias("rank"), F.col("context").alias("text"))


class VecGraphMemory(Memory):
    """Described triplets with resolved entities, searched by similarity and one hop further."""

    name = "vecgraph"
    tables = ("entities", "aliases", "sources", "triplets")
    _triplet_schema = (
        "trip_id long, subject string, predicate string, description string, object string, "
        "subject_key string, object_key string, source_hash string, embedding array<float>"
    )

    def __init__(
        self, spark: SparkSession, config: ExperimentConfig, models: Models,
        store: TableStore | None = None, calls: list[DataFrame] | None = None,
    ) -> None:
        super().__init__(spark, config, models, store, calls)
        if config.vecgraph is None:
            from lodestone.config import VecGraphConfig

            config.vecgraph = VecGraphConfig()

    def entities(self) -> DataFrame:
        return self.store.read("entities", "entity_id long, entity_key string, name string, embedding array<float>")

    def aliases(self) -> DataFrame:
        """Other names of entities; ``alias_id`` ascends in the order in which they were found."""
        return self.store.read("aliases", "alias_key string, alias string, entity_key string, alias_id long")

    def sources(self) -> DataFrame:
        """Chunks an entity was found in, one row each; ``first_trip`` ascends in the order in which they were."""
        return self.store.read("sources", "entity_key string, source_hash string, first_trip long")

    def entity_names(self) -> DataFrame:
        """``(entity_key, alias_no, alias)``: the names of every entity in order, its own as number 0."""
        others = running_number(self.aliases(), ["entity_key"], ["alias_id", "alias"], name="alias_no")
        own = self.entities().select("entity_key", F.lit(0).cast("long").alias("alias_no"), F.col("name").alias("alias"))
        return own.unionByName(others.select("entity_key", "alias_no", "alias"))

    def entity_sources(self) -> DataFrame:
        """``(entity_key, source_no, source_hash)``: the chunks of every entity in order, from 1."""
        numbered = running_number(self.sources(), ["entity_key"], ["first_trip", "source_hash"], name="source_no")
        return numbered.select("entity_key", "source_no", "source_hash")

    def triplets(self) -> DataFrame:
        return self.store.read("triplets", self._triplet_schema)

    def _chunks(self, docs: DataFrame, chunked: bool) -> DataFrame:
        if chunked:
            cut = self.config.ingestion
            pieces = chunk_documents(docs, cut.chunk_size, cut.chunk_overlap)
        else:
            whole = clean_documents(docs)
            pieces = whole.select(
                "doc_id", F.lit(0).alias("chunk_no"), F.col("text").alias("chunk"),
                text_md5(F.col("text")).alias("source_hash"),
            )
        return pieces.select("doc_id", "chunk_no", "chunk", "source_hash")

    def _resolve(self, found: DataFrame, phase: str, run_id: str) -> None:
        """Create entities and aliases for the names of new triplets, in order of occurrence."""
        names = found.select(
            "ord", F.posexplode(F.array("subject", "object")).alias("side", "name")
        ).select(F.struct("ord", "side").alias("at"), "name", norm_name(F.col("name")).alias("entity_key"))
        first = names.groupBy("entity_key").agg(F.min(F.struct("at", "name")).alias("f")).select(
            "entity_key", F.col("f.at.ord").alias("ord"), F.col("f.at.side").alias("side"), F.col("f.name").alias("name")
        )
        known = self.entities()
        unknown = first.join(known.select("entity_key"), "entity_key", "left_anti").join(
            self.aliases().select(F.col("alias_key").alias("entity_key")), "entity_key", "left_anti"
        )
        fresh = running_number(unknown, [], ["ord", "side"], name="entity_id").withColumn(
            "entity_id", F.col("entity_id") + F.lit(self._after(known, "entity_id"))
        )
        fresh = checkpoint(
            fresh.select("entity_id", "entity_key", "name", self.models.embed(F.col("name")).alias("embedding"))
        )
        self._log_embedding(fresh, F.col("name"), phase, run_id)
        everyone = known.withColumn("settled", F.lit(True)).unionByName(fresh.withColumn("settled", F.lit(False)))

        def select(name: Column, candidates: Column) -> Column:
            return self.models.choose(choice_prompt(name, numbered_block(candidates)))

        cfg = self.config.vecgraph
        owners = checkpoint(
            entities.resolve_entities(
                everyone.select(F.col("entity_id").alias("id"), "name", "embedding", "settled"),
                select, cfg.entity_lm_top_k, cfg.entity_lm_lower,
                on_replies=lambda replies: self._log(replies, "reply", phase, "graph_extract", F.lit(run_id)),
            )
        )
        decided = fresh.join(owners, F.col("entity_id") == F.col("id"))
        merged = decided.where(F.col("owner") != F.col("id")).select(
            F.col("entity_key").alias("alias_key"), F.col("name").alias("alias"), "owner", F.col("entity_id").alias("alias_id")
        )
        keys = everyone.select(F.col("entity_id").alias("owner"), "entity_key")
        self.store.append("aliases", checkpoint(merged.join(keys, "owner").select("alias_key", "alias", "entity_key", "alias_id")))
        self.store.append(
            "entities",
            decided.where(F.col("owner") == F.col("id")).select("entity_id", "entity_key", "name", "embedding"),
        )

    def _canonical(self, found: DataFrame, side: str) -> DataFrame:
        """Replace a name by its entity's, and add the entity's key."""
        resolved = entities.resolve_names(
            found.withColumn("name", F.col(side)), self.entities(), self.aliases()
        ).withColumnRenamed("entity_key", f"{side}_key")
        named = self.entities().select(F.col("entity_key").alias(f"{side}_key"), F.col("name").alias("__canonical"))
        return resolved.drop("name", side).join(named, f"{side}_key").withColumnRenamed("__canonical", side)

    def _ingest(self, docs: DataFrame, phase: str, run_id: str, chunked: bool) -> None:
        chunks = self._chunks(docs, chunked)
        replies = checkpoint(
            chunks.select("doc_id", "chunk_no", "source_hash", self.models.described_triples(F.col("chunk")).alias("r"))
        )
        self._log(replies, "r", phase, "graph_extract", F.lit(run_id))
        parsed = triples.parse_triplets(
            replies.select("doc_id", "chunk_no", "source_hash", F.col("r.reply").alias("reply")),
            "doc_id", "chunk_no", "source_hash",
        )
        order = ["doc_id", "chunk_no", "source_hash", "item_no"]
        found = checkpoint(running_number(parsed, [], order, name="ord").drop("doc_id", "chunk_no", "item_no"))
        self._resolve(found, phase, run_id)
        keyed = self._canonical(self._canonical(found, "subject"), "object")
        offset = self._after(self.triplets(), "trip_id")
        fresh = triples.dedup_triplets(keyed).withColumn("trip_id", F.col("ord") - 1 + F.lit(offset))
        same = strip_ws(F.lower("description"))
        known = self.triplets().select("subject_key", "object_key", same.alias("d")).distinct()
        fresh = fresh.withColumn("d", same).join(known, ["subject_key", "d", "object_key"], "left_anti")
        text = triplet_embed_text(F.col("subject"), F.col("description"))
        fresh = checkpoint(
            fresh.select(
                "trip_id", "subject", "predicate", "description", "object", "subject_key", "object_key",
                "source_hash", self.models.embed(text).alias("embedding"),
            )
        )
        self._log_embedding(fresh, text, phase, run_id)
        ends = fresh.select(
            F.explode(F.array("subject_key", "object_key")).alias("entity_key"), "source_hash", "trip_id"
        ).groupBy("entity_key", "source_hash").agg(F.min("trip_id").alias("first_trip"))
        self.store.append("sources", ends.join(self.sources(), ["entity_key", "source_hash"], "left_anti"))
        # Rows kept earlier can never fall later, so only the new ones are judged:
        # first against the stored ledger, which is read once and not shuffled for
        # a small addition, then among themselves.
        threshold = self.config.vecgraph.dedup_threshold
        corpus = self.triplets().select(F.col("trip_id").alias("id"), F.col("embedding").alias("vec"))
        nearest = knn.knn_search(corpus, fresh.select(F.col("trip_id").alias("qid"), F.col("embedding").alias("vec")), 1)
        stale = nearest.where(F.col("cos") > threshold).select(F.col("qid").alias("trip_id"))
        new = checkpoint(fresh.join(stale, "trip_id", "left_anti"))
        judged = semantic_dedup(new.select(F.col("trip_id").alias("id"), "embedding"), threshold)
        kept = judged.where("kept").select(F.col("id").alias("trip_id"))
        self.store.append("triplets", new.join(kept, "trip_id", "left_semi"))

    def _search(self, queries: DataFrame) -> DataFrame:
        stripped = queries.withColumn("query", strip_ws(F.col("query")))
        asked = checkpoint(stripped.select("qid", "query", self.models.embed(F.col("query")).alias("vec")))
        self._log_embedding(asked, F.col("query"), "retrieval_overhead", "search")
        return vecgraph.vecgraph_search(self.triplets(), asked.select("qid", "vec"), self.k)

    @property
    def entity_count(self) -> int:
        return self.entities().count()

    @property
    def triplet_count(self) -> int:
        return self.triplets().count()

    index_size = triplet_count
    store_size = triplet_count


MEMORIES = {m.name: m for m in (OverlapMemory, Bm25Memory, VectorMemory, GraphMemory, HybridMemory, VecGraphMemory)}


def build_memory(
    spark: SparkSession, config: ExperimentConfig, models: Models, store: TableStore | None = None, calls: list[DataFrame] | None = None
) -> Memory:
    return MEMORIES[config.agent_type](spark, config, models, store, calls)
