"""Arrays of a JSON file cut into many splits, against a parser that reads it whole."""

import json
import random

import pytest

from lodestone.sources.datasets import read_documents, read_questions
from lodestone.sources.jsonarrays import json_array_items


def _read(spark, path, keys=("documents", "questions")):
    rows = json_array_items(spark, str(path), keys).collect()
    return {key: [json.loads(r.item) for r in sorted(rows, key=lambda r: r.item_no) if r.key == key] for key in keys}


def _text(rng):
    return "".join(rng.choice('ab é𝄞"\\{}[],:\n\t') for _ in range(rng.randint(0, 40)))


@pytest.mark.parametrize("indent", [None, 2])
def test_many_splits(spark, tmp_path, indent):
    rng = random.Random(3)
    whole = {
        "version": "documents", "meta": {"documents": [1, {"questions": ["x"]}], "n": 2},
        "documents": [_text(rng) for _ in range(300)],
        "questions": [{"question": _text(rng), "tags": [_text(rng), [1, None]], "hops": i} for i in range(100)] + [None, 1.5, [], {}],
        "empty": [], "rest": [1, 2], "last": "documents", "none": {"questions": [3]},
    }
    path = tmp_path / "data.json"
    path.write_text(json.dumps(whole, indent=indent, ensure_ascii=False), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert spark.read.text(str(path), lineSep='"').rdd.getNumPartitions() > 4
        assert _read(spark, path) == {k: whole[k] for k in ("documents", "questions")}
        assert _read(spark, path, ("empty", "absent", "rest")) == {"empty": [], "absent": [], "rest": [1, 2]}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_repeated_key_and_small_files(spark, tmp_path):
    path = tmp_path / "data.json"
    path.write_text('{"documents": ["a", "b"], "documents" : [ "c" ] }\n')
    assert _read(spark, path)["documents"] == ["c"]
    for text in ("{}", "", '{"documents": {"a": [1]}, "questions": "x"}'):
        path.write_text(text)
        assert _read(spark, path) == {"documents": [], "questions": []}


def test_dataset_readers(spark, tmp_path):
    path = tmp_path / "data.json"
    whole = {
        "documents": ["first \"quoted\"", None, "", "third \\"],
        "questions": [{"question": "q0", "expected": "e", "answer": "a", "hops": 2}, {"expected": "only"}, {"question": None}],
    }
    path.write_text(json.dumps(whole, indent=2))
    docs = [tuple(r) for r in read_documents(spark, str(path)).orderBy("doc_id").collect()]
    assert docs == [(0, 'first "quoted"'), (2, ""), (3, "third \\")]
    asked = [tuple(r) for r in read_questions(spark, str(path)).orderBy("qid").collect()]
    assert asked == [(0, "q0", "a"), (1, "", "only"), (2, "", "")]
