import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import costs, dataset, ranking, scoring


def sample_brute(rows, n):
    strata = {}
    for i, a, b in rows:
        strata.setdefault((a or "unknown", b or "unknown"), []).append(i)
    out = []
    for group in strata.values():
        out += group[: max(1, round(n * len(group) / len(rows)))]
    if len(out) >= n:
        return out[:n]
    return out + [i for i, *_ in rows if i not in out][: n - len(out)]


@pytest.mark.parametrize("n", [1, 4, 7, 20, 33, 90, 200])
def test_sample_equals_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice(["x", "x", "x", "y", None]), rng.choice(["e", "h", "h"])) for i in range(100)]
    df = spark.createDataFrame(rows, "idx long, type string, level string")
    got = dataset.stratified_sample(df, ["type", "level"], n).orderBy("position").collect()
    assert [r.idx for r in got] == sample_brute(rows, n)


def test_paragraphs_pair_up_to_the_shorter_list_and_keep_the_first(spark):
    samples = spark.createDataFrame(
        [(0, (["T", "U", "V"], [["a.", "b."], ["c."]])), (1, (["U", "W"], [["c."], ["d."], ["e."]])), (2, None)],
        "idx long, context struct<title: array<string>, sentences: array<array<string>>>")
    rows = dataset.extract_documents(samples).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["T: a. b.", "U: c.", "W: d."]


def test_paragraphs_of_any_sample_number_get_small_ids_in_order(spark):
    samples = spark.createDataFrame(
        [((1 << 62) + i, (["T"], [[f"{i}."]])) for i in (2, 0, 1)],
        "idx long, context struct<title: array<string>, sentences: array<array<string>>>")
    rows = dataset.extract_documents(samples).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in rows] == [(0, "T: 0."), (1, "T: 1."), (2, "T: 2.")]


def test_answer_wins_over_expected(spark):
    q = spark.createDataFrame([("a", "e"), (None, "e"), (None, None)], "answer string, expected string")
    assert [r[0] for r in q.select(dataset.expected_answer(q)).collect()] == ["a", "e", ""]


def test_running_number_over_a_large_group(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 5).cast("string"))).alias("g"),
        F.xxhash64("id").alias("t"), "id")
    got = ranking.running_number(rows, ["g"], ["t", "id"]).collect()
    groups = {}
    for r in sorted(got, key=lambda r: (r.t, r.id)):
        groups[r.g] = groups.get(r.g, 0) + 1
        assert r.row_no == groups[r.g]
    whole = ranking.running_number(rows, [], ["id"]).collect()
    assert all(r.row_no == r.id + 1 for r in whole)


def test_top_k_beyond_the_planner_limit(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("g"), "id")
    got = ranking.top_k(rows, ["g"], [F.desc("id")], 1500)
    assert got.count() == 3000 and got.agg(F.min("id")).first()[0] == 2000


CALL = ("ok boolean, ts timestamp, run_id string, phase string, actor string, variant_name string, model string, "
        "prompt_tokens long, completion_tokens long, reasoning_tokens long, total_tokens long, seconds double, "
        "error string")


def test_call_records(spark):
    rows = spark.createDataFrame([
        (True, None, "r", "ingest", "graph_extract", "v", "m", 100, 50, None, None, 1.1245, None),
        (True, None, None, None, None, None, "m", 1, 1, 7, 9, 0.0, None),
        (False, None, "r", None, None, "v", "m", None, None, None, None, 1.0, "boom"),
    ], CALL)
    records = costs.call_records(rows)
    good, bare, bad = [r.asDict() for r in records.collect()]
    assert good["total_tokens"] == 150 and good["reasoning_tokens"] == 0 and good["latency_ms"] == 1124.5
    assert (bare["run_id"], bare["phase"], bare["variant_name"]) == ("unknown", "UNTAGGED", "unknown")
    assert bare["total_tokens"] == 9
    assert bad["event"] == "llm_error" and bad["error"] == "boom" and bad["total_tokens"] is None
    assert costs.untagged_calls(records).count() == 1
    total = costs.cost_by(records, ["run_id"]).where("run_id = 'r'").first()
    assert (total.calls, total.failures, total.total_tokens) == (1, 1, 150)


def test_scores(spark):
    rows = [(0, "The Eiffel Tower!", "eiffel tower"), (1, "in Paris France", "Paris"), (2, "yes it is", "yes"),
            (3, "", ""), (4, "x y", "z"), (5, "a a b b b", "b b c")]
    df = spark.createDataFrame(rows, "id long, answer string, expected string")
    got = {r.id: (r.exact_match, round(r.f1, 4)) for r in scoring.score_answers(df).collect()}
    assert got == {0: (1, 1.0), 1: (0, 0.5), 2: (0, 0.0), 3: (1, 0.0), 4: (0, 0.0), 5: (0, 0.6667)}
