import json

import pytest
from pyspark.sql import functions as F

import main as cli
from lodestone import plugins
from lodestone.config import ExperimentConfig, LLMConfig, RetrievalConfig, _typed, layered, list_variants, load_config
from lodestone.plans.agent import Agent
from lodestone.plans.memories import MEMORIES, build_memory
from lodestone.plans.pipelines import flush_calls, run_ingest, run_qa
from lodestone.sources.logs import read_calls

TEXTS = [
    "Nikola Tesla was born in Smiljan.", "  ", "Zagreb is the capital of Croatia.",
    "Nikola Tesla invented the induction motor.", "Berlin is the capital of Germany.",
]
MINIMAL = """
telemetry: {log_level: DEBUG}
default:
  agent_type: dummy
  data_file: d.json
  llm: {model: p/m, temperature: 0.5}
  embedding: {model: p/e, batch_size: 8}
  retrieval: {top_k: 3, similarity_cutoff: 0.5}
  ingestion: {chunk_size: 256, chunk_overlap: 32}
variants:
  base: {}
  graph: {agent_type: graph, retrieval: {top_k: 7}}
  wrong: {agent_type: other}
  overlap: {ingestion: {chunk_overlap: 256}}
  model: {llm: {model: nomodel}}
"""


@pytest.fixture
def config_file(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text(MINIMAL)
    return path


def test_variants_merge_over_defaults(config_file):
    cfg = load_config("graph", config_file)
    assert (cfg.agent_type, cfg.retrieval.top_k, cfg.retrieval.similarity_cutoff) == ("graph", 7, 0.5)
    assert (cfg.llm.model, cfg.llm.temperature, cfg.telemetry.log_level) == ("p/m", 0.5, "DEBUG")
    assert list_variants(config_file) == ["base", "graph", "wrong", "overlap", "model"]
    base = {"a": {"b": 1, "c": 2}}
    assert layered(base, {"a": {"c": 3}, "d": 4}) == {"a": {"b": 1, "c": 3}, "d": 4} and base == {"a": {"b": 1, "c": 2}}


def test_invalid_variants_are_refused(config_file):
    for name in ("wrong", "overlap", "model"):
        with pytest.raises(ValueError):
            load_config(name, config_file)
    with pytest.raises(KeyError, match="base"):
        load_config("nothing", config_file)
    assert {load_config(v).agent_type for v in list_variants()} == set(MEMORIES)


def variant(kind: str, path) -> ExperimentConfig:
    cfg = load_config({m.agent_type: m for m in map(load_config, list_variants())}[kind].variant_name)
    cfg.memory_path, cfg.retrieval.similarity_cutoff = str(path / kind), 0.55
    cfg.telemetry.output_dir = str(path / "log")
    return cfg


@pytest.mark.parametrize("kind", ["dummy", "bm25", "vector", "graph"])
def test_ids_of_any_size_do_not_collide(spark, tmp_path, kind):
    memory = build_memory(spark, variant(kind, tmp_path), plugins.offline_models(dim=128))
    ids = [1, 1 + (1 << 40), 524288 << 20, (1 << 63) - 1]
    texts = [TEXTS[i] for i in (0, 2, 3, 4)]
    for _ in range(2):  # the second time behind stored rows
        memory.ingest_documents(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"))
    table, column = {"vector": (lambda: memory.chunks(), "chunk_id"), "graph": (lambda: memory.edges(), "eid")}.get(
        kind, (lambda: memory.docs(), "doc_id"))
    numbers = sorted(r[0] for r in table().select(column).collect())
    assert len(set(numbers)) == len(numbers) >= 4 and 0 <= numbers[0] and numbers[-1] < 20
    if kind == "vector":
        hits = memory.search_many(spark.createDataFrame([(0, TEXTS[0])], "qid long, query string")).collect()
        assert sum(r.text == TEXTS[0] for r in hits) == 2


@pytest.mark.parametrize("kind", list(MEMORIES))
def test_memory_life_cycle(spark, tmp_path, kind):
    models = plugins.offline_models(dim=128)
    memory = build_memory(spark, variant(kind, tmp_path), models)
    assert memory.store_size == 0 and memory.search("Tesla") == []
    memory.ingest_documents(TEXTS)
    assert memory.store_size == 4
    found = memory.search("Nikola Tesla Smiljan")
    assert found and "Smiljan" in found[0] and memory.search("   ") == []
    memory.update_fact("  ")
    memory.update_fact("Ottawa is the capital of Canada.")
    # A second object sees the same tables.
    again = build_memory(spark, variant(kind, tmp_path), models)
    assert again.store_size == 5 and any("Canada" in t for t in again.search("Ottawa Canada"))
    again.reset()
    assert memory.store_size == 0 and memory.search("Tesla") == []


def test_a_repeated_fact_is_kept_once_in_graphs(spark, tmp_path):
    for kind in ("graph", "vecgraph"):
        memory = build_memory(spark, variant(kind, tmp_path), plugins.offline_models())
        memory.ingest_documents(TEXTS[:3])
        memory.update_fact(TEXTS[0])
        assert memory.store_size == 2


def test_merged_names_take_the_canonical_form(spark, tmp_path):
    replies = {
        "one": [("N. Tesla", "p", "lives", "X")], "two": [("Nikola Tesla", "p", "works", "X"), ("n. tesla ", "p", "rests", "Y")],
    }
    texts = {"N. Tesla": [1.0, 0.05, 0.0], "Nikola Tesla": [1.0, 0.0, 0.05], "X": [0.0, 1.0, 0.0], "Y": [0.0, 0.0, 1.0],
             "N. Tesla lives": [1.0, 0.0, 0.0], "N. Tesla works": [0.0, 1.0, 0.0], "N. Tesla rests": [0.0, 0.0, 1.0]}
    keys = ("subject", "predicate", "description", "object")
    table = {k: json.dumps([dict(zip(keys, t)) for t in v]) for k, v in replies.items()}

    def extract(text):
        reply = F.lit("[]")
        for word, answer in table.items():
            reply = F.when(text.contains(word), answer).otherwise(reply)
        return F.struct(reply.alias("reply"), *[F.lit(0).cast("long").alias(c) for c in (
            "prompt_tokens", "completion_tokens", "reasoning_tokens", "total_tokens")],
            F.lit(0.0).alias("seconds"), F.lit(None).cast("string").alias("error"))

    embed = plugins.batched_embedder(lambda batch: [texts[t] for t in batch], 2)
    models = plugins.Models(embed=embed, described_triples=extract, choose=lambda p: extract(p).withField("reply", F.lit("1")))
    memory = build_memory(spark, variant("vecgraph", tmp_path), models)
    memory.config.vecgraph.dedup_threshold = 0.9999
    memory.ingest_documents(["text one", "text two"])
    assert {r.entity_key for r in memory.entities().collect()} == {"n. tesla", "x", "y"}
    assert [(r.alias, r.entity_key) for r in memory.aliases().collect()] == [("Nikola Tesla", "n. tesla")]
    rows = sorted((r.trip_id, r.subject, r.description) for r in memory.triplets().collect())
    assert [r[1:] for r in rows] == [("N. Tesla", "lives"), ("N. Tesla", "works"), ("N. Tesla", "rests")]


def test_later_triplets_are_judged_like_earlier_ones(spark, tmp_path):
    """Two ingestions leave the same ledger as one, with near copies within and across them."""
    texts = [f"Alpha{i % 5} was born in Town{i % 4}." for i in range(12)] + [f"Town{i} is the capital of Land{i}." for i in range(4)]
    ledgers = []
    for parts in ([texts], [texts[:7], texts[7:]]):
        memory = build_memory(spark, variant("vecgraph", tmp_path / str(len(parts))), plugins.offline_models(dim=16))
        memory.config.vecgraph.dedup_threshold = 0.6
        for part in parts:
            memory.ingest_documents(part)
        rows = memory.triplets().orderBy("trip_id").collect()
        ledgers.append([(r.subject, r.description, r.object) for r in rows])
    assert ledgers[0] == ledgers[1] and 0 < len(ledgers[0]) < 16


def dataset_file(tmp_path):
    (tmp_path / "d").mkdir()
    data = {"documents": TEXTS, "questions": [{"question": "Where was Tesla born?", "expected": "Smiljan", "hops": 1},
                                              {"question": "zzz", "answer": "none", "expected": "x"}]}
    (tmp_path / "d" / "d.json").write_text(json.dumps(data, indent=2))
    (tmp_path / "d" / "empty.json").write_text("{}")
    return str(tmp_path / "d")


def test_pipelines_write_results_and_a_call_log(spark, tmp_path):
    folder = dataset_file(tmp_path)
    cfg = variant("dummy", tmp_path)
    cfg.data_file = "d.json"
    models = plugins.offline_models()
    log = str(tmp_path / "calls")
    run_ingest(spark, cfg, models, folder, log)
    path = run_qa(spark, cfg, models, folder, str(tmp_path / "out"), log)
    rows = {r.question: r for r in spark.read.json(path).collect()}
    assert len(rows) == 2 and rows["zzz"].expected == "none" and rows["zzz"].context_used == []
    hit = rows["Where was Tesla born?"]
    assert hit.answer == TEXTS[0] and hit.steps_taken == ["retrieve", "reason"] and len(hit.run_id) == 36
    calls = read_calls(spark, log).collect()
    assert {c.run_id for c in calls} == {r.run_id for r in rows.values()}
    assert sorted(c.call_index for c in calls) == [1, 2]
    assert {(c.phase, c.actor) for c in calls} == {("agent_reasoning", "langgraph_node")}

    cfg.data_file = "empty.json"
    assert run_ingest(spark, cfg, models, folder, log) is None
    assert build_memory(spark, cfg, models).store_size == 4
    assert run_qa(spark, cfg, models, folder, str(tmp_path / "out"), log).endswith(f"{cfg.variant_name}_results.jsonl")


def test_call_index_continues_over_ingest_update_and_answers(spark, tmp_path):
    folder = dataset_file(tmp_path)
    cfg = variant("vecgraph", tmp_path)
    cfg.data_file = "d.json"
    models = plugins.offline_models()
    log = str(tmp_path / "calls")
    memory = run_ingest(spark, cfg, models, folder, log)
    taken = spark.read.json(log).count()
    assert taken > 0
    memory.update_fact("Vienna is a city.")
    flush_calls(memory, log)
    run_qa(spark, cfg, models, folder, str(tmp_path / "out"), log)
    calls = sorted(read_calls(spark, log).collect(), key=lambda c: c.call_index)
    assert [c.call_index for c in calls] == list(range(1, len(calls) + 1))
    assert [c.timestamp for c in calls] == sorted(c.timestamp for c in calls)
    assert {c.phase for c in calls[:taken]} == {"ingest"}
    # Queries are embedded before the model reasons about their hits.
    phases = [c.phase for c in calls if c.actor == "langgraph_node" or c.phase == "retrieval_overhead"]
    assert phases.index("retrieval_overhead") < phases.index("agent_reasoning")


def test_single_question_and_tool(spark, tmp_path):
    agent = Agent(build_memory(spark, variant("dummy", tmp_path), plugins.offline_models()))
    agent.update_memory("The sky is blue.")
    response = agent.run("what is the sky")
    assert set(response) == {"run_id", "question", "answer", "context_used", "steps_taken", "backend_name"}
    assert response["context_used"] == ["The sky is blue."] and response["backend_name"] == "dummy"


def test_command_line(spark, tmp_path, config_file, capsys):
    assert cli.main(["--variant", "base"]) == 1
    folder = dataset_file(tmp_path)
    config_file.write_text(MINIMAL.replace("log_level: DEBUG", f"output_dir: {tmp_path / 'log'}"))
    code = cli.main(["--variant", "base", "--ingest", "--qa", "--config", str(config_file), "--data-dir", folder,
                     "--output-dir", str(tmp_path / "o"), "--models", "offline"])
    assert code == 0 and "results.jsonl" in capsys.readouterr().out


def test_stream_of_facts(spark, tmp_path):
    from lodestone.streaming.facts import follow_facts, read_call_stream

    source = str(tmp_path / "facts")
    spark.createDataFrame([(0, "Mars is red."), (1, "")], "doc_id long, text string").write.parquet(source)
    memory = build_memory(spark, variant("bm25", tmp_path), plugins.offline_models())
    stream = spark.readStream.schema("doc_id long, text string").parquet(source)
    follow_facts(stream, memory, str(tmp_path / "cp")).awaitTermination(60)
    assert memory.search("mars") == ["Mars is red."]
    assert read_call_stream(spark, str(tmp_path)).isStreaming


def test_calls_of_selection_and_hybrid_ingest_are_noted(spark, tmp_path):
    texts = ["Alpha One was born in Paris.", "Alpha Two was born in Paris.", "Alpha Three was born in Rome."]
    shared = []
    memory = build_memory(spark, variant("vecgraph", tmp_path / "v"), plugins.offline_models(), calls=shared)
    memory.config.vecgraph.entity_lm_lower = 0.3
    memory.ingest_documents(texts)
    noted = [c for df in memory.calls for c in df.collect()]
    # Three extractions; the second and third Alpha are each put before the model once.
    extracted = [c for c in noted if c.actor == "graph_extract"]
    assert len(extracted) == 5 and {c.phase for c in extracted} == {"ingest"} and {c.run_id for c in extracted} == {"ingest"}
    assert sorted(c.completion_tokens for c in extracted)[:2] == [1, 1]
    hybrid = build_memory(spark, variant("lightrag", tmp_path / "h"), plugins.offline_models(), calls=shared)
    before = len(shared)
    hybrid.ingest_documents(texts)
    embedded = [c for df in shared[before:] for c in df.collect() if c.actor == "vector_embed"]
    assert hybrid.calls is memory.calls and len(embedded) == 5 + 3
    hybrid.update_fact("Rome is located in Italy.")
    late = [c for df in shared for c in df.collect() if c.actor == "vector_embed" and c.phase == "agent_reasoning"]
    assert len(late) == 2 and {c.run_id for c in late} == {"update_fact"}


def test_names_and_sources_of_entities_are_ordered(spark, tmp_path):
    models = plugins.offline_models()
    first = lambda p: models.choose(p).withField("reply", F.lit("1"))
    memory = build_memory(spark, variant("vecgraph", tmp_path), plugins.Models(embed=models.embed, choose=first))
    memory.config.vecgraph.entity_lm_lower = 0.3
    memory.config.vecgraph.dedup_threshold = 0.9999
    memory.ingest_documents([f"Alpha {n} was born in Paris." for n in ("Zero", "Two", "One")])
    names = sorted((r.entity_key, r.alias_no, r.alias) for r in memory.entity_names().collect())
    assert names == [("alpha zero", 0, "Alpha Zero"), ("alpha zero", 1, "Alpha Two"), ("alpha zero", 2, "Alpha One"), ("paris", 0, "Paris")]
    seen = [r.source_no for r in memory.entity_sources().where("entity_key = 'paris'").collect()]
    assert sorted(seen) == list(range(1, len(seen) + 1)) and seen


@pytest.mark.parametrize("kind", ["dummy", "bm25", "vector", "graph", "lightrag", "vecgraph"])
def test_a_replayed_batch_adds_nothing(spark, tmp_path, kind):
    from lodestone.sources.store import TableStore

    store = TableStore(spark, str(tmp_path / "given"))
    memory = build_memory(spark, variant(kind, tmp_path), plugins.offline_models(), store=store)
    batch = spark.createDataFrame([(0, TEXTS[0]), (1, TEXTS[1])], "doc_id long, text string")
    assert memory.ingest_batch(batch, "stream", 0)
    held = memory.store_size
    assert not memory.ingest_batch(batch, "stream", 0) and memory.store_size == held > 0
    other = build_memory(spark, variant(kind, tmp_path), plugins.offline_models(), store=store)
    assert other.store_size == held and not other.ingest_batch(batch, "stream", 0)
    assert other.ingest_batch(batch.limit(0), "stream", 1) and other.store_size == held


def test_postings_have_one_file_a_bucket(spark, tmp_path):
    memory = build_memory(spark, variant("bm25", tmp_path), plugins.offline_models())
    memory.ingest_documents(TEXTS * 20)
    files = [r[0] for r in memory.postings().select(F.input_file_name()).distinct().collect()]
    assert 0 < len(files) <= memory.store.buckets("postings")
    assert len({f.rsplit("_", 1)[1] for f in files}) == len(files)


def test_settings_are_typed(config_file):
    text = config_file.read_text()
    config_file.write_text(text.replace("top_k: 5", "top_k: x") if "top_k: 5" in text else text + "\n")
    with pytest.raises(ValueError):
        _typed(RetrievalConfig, "top_k", int, "x")
    assert _typed(RetrievalConfig, "top_k", int, "7") == 7 and _typed(RetrievalConfig, "similarity_cutoff", float, 1) == 1.0
    assert _typed(LLMConfig, "api_base", str | None, None) is None
    for bad in (True, 2.5, [1]):
        with pytest.raises(ValueError):
            _typed(RetrievalConfig, "top_k", int, bad)
