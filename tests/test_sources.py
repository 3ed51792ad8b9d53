import json

from lodestone.plans.prepare import prepare
from lodestone.sources.datasets import read_documents, read_questions
from lodestone.sources.store import TableStore


def test_store_replaces_a_table_by_what_is_computed_from_it(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    assert store.read("t", "id long").count() == 0 and not store.exists("t")
    store.append("t", spark.range(3))
    store.append("t", spark.range(3, 5))
    for _ in range(3):
        store.replace("t", store.read("t", "id long").where("id > 0").selectExpr("id - 1 AS id"))
    assert [r.id for r in store.read("t", "id long").orderBy("id").collect()] == [0, 1]
    store.drop("t")
    assert store.read("t", "id long").count() == 0


def test_buckets_need_no_shuffle(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    layout = ("id bigint, term string", "id", "term")
    for start in (0, 50):
        rows = spark.range(start, start + 50).selectExpr("id", "cast(id % 7 AS string) AS term")
        store.append_bucketed("p", rows, *layout)
    table = TableStore(spark, str(tmp_path / "s")).read_bucketed("p", *layout)
    grouped = table.groupBy("id", "term").count()
    assert table.count() == 100 and "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    store.drop("p")
    assert store.read_bucketed("p", *layout).count() == 0


def test_prepared_dataset_can_be_read_back(spark, tmp_path):
    lines = [
        {"id": str(i), "question": f"q{i}?", "answer": f"a{i}", "type": "bridge" if i % 4 else "comparison",
         "context": {"title": [f"T{i % 3}", "Same"], "sentences": [[f"s{i % 3}."], ["x.", "y."]]}}
        for i in range(20)
    ]
    source = tmp_path / "dump.json"
    source.write_text("\n".join(map(json.dumps, lines)))
    out = str(tmp_path / "out")
    counts = {(r.key, r.value): r.n for r in prepare(spark, str(source), out, 8).collect()}
    assert counts == {("type", "bridge"): 6, ("type", "comparison"): 2, ("level", "unknown"): 8}
    assert read_documents(spark, out).count() == 4
    first = read_questions(spark, out).orderBy("qid").first()
    assert (first.question, first.expected) == ("q0?", "a0")
