import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, triples, vecgraph


def bfs(edges, query, k):
    tokens = [t.lower() for t in query.split() if len(t) > 2]
    nodes = {n for _, s, _, o in edges for n in (s, o)}
    frontier = {n for n in nodes if any(t in n.lower() for t in tokens)}
    visited, seen, out = set(frontier), set(), []
    for hop in (1, 2):
        following = set()
        for eid, s, p, o in edges:
            if (s in frontier or o in frontier) and eid not in seen:
                seen.add(eid)
                out.append((hop, eid))
                other = o if s in frontier else s
                if other not in visited:
                    following.add(other)
                    visited.add(other)
        frontier = following
        if not frontier:
            break
    return out[:k]


@pytest.mark.parametrize("k", [1, 3, 7, 40])
def test_search_equals_breadth_first(spark, k):
    rng = random.Random(3)
    # A third of all edges touch one hub; some nodes are loops or far away.
    names = [f"node {i:02d}" for i in range(40)]
    ends = [(names[0] if i % 3 == 0 else rng.choice(names), rng.choice(names)) for i in range(120)]
    edges = list(dict.fromkeys((s, "rel_to", o) for s, o in ends))
    edges = [(i, *e) for i, e in enumerate(edges)]
    queries = [f"what of {n} ?" for n in ("00", "01 node", "07", "19", "33", "zz")] + ["node", "no", " ", "e 12 e"]
    queries += [f"x {i:02d}x 00{i}" for i in range(5)] + [f" {i:02d} " for i in range(40)]
    queries += [f"de {i:02d} ode" for i in range(3)]
    edf = spark.createDataFrame(edges, "eid long, subject string, predicate string, object string")
    edf = edf.withColumn("subject", F.replace("subject", F.lit(" "), F.lit("_"))).withColumn(
        "object", F.replace("object", F.lit(" "), F.lit("_")))
    under = [(i, s.replace(" ", "_"), p, o.replace(" ", "_")) for i, s, p, o in edges]
    queries += [f"node_{i:02d}" for i in range(40)]
    qdf = spark.createDataFrame(list(enumerate(queries)), "qid long, query string")
    got = sorted((r.qid, r["rank"], r.hop, r.eid) for r in graph.graph_search(edf, qdf, k).collect())
    want = [(q, r + 1, h, e) for q, text in enumerate(queries) for r, (h, e) in enumerate(bfs(under, text, k))]
    assert got == want


def test_second_hop_is_reached_and_underscores_go(spark):
    edges = spark.createDataFrame(
        [(0, "A1x", "born_in", "B"), (1, "B", "capital_of", "C")],
        "eid long, subject string, predicate string, object string")
    queries = spark.createDataFrame([(0, "who is a1x"), (1, "who is a1x?")], "qid long, query string")
    rows = graph.graph_search(edges, queries, 5).orderBy("rank").collect()
    assert [(r.qid, r.text) for r in rows] == [(0, "A1x born in B"), (0, "B capital of C")]
    assert graph.graph_size(edges).first().asDict() == {"nodes": 3, "edges": 2}


REPLIES = [
    ("nope", 0), ('{"subject":"A","predicate":"p","object":"B"}', 0), ("[1, 2] trailing", 0), (None, 0), ("", 0),
    ('[1]} {"x":1', 0), ("[1], [2]", 0), ('[{"subject":"A","predicate":"p"}]', 0),
    ('[{"subject":"A","predicate":"p","object":" "}]', 0), ('[{"subject":1,"predicate":"p","object":"B"}]', 0),
    ('[{"subject":" A ","predicate":"p","object":"B","more":[1]}, 3, null, "x"]', 1), ("[]", 0), ("[[]]", 0),
    (' [{"subject":"A","predicate":"p","object":"B"}]\n', 1),
]


def test_edge_replies(spark):
    rows = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "doc_id long, reply string")
    found = triples.parse_edges(rows).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in found} == {i: n for i, (_, n) in enumerate(REPLIES) if n}
    assert {r.subject for r in triples.parse_edges(rows).collect()} == {"A"}


def test_described_replies_coerce_truthy_values(spark):
    item = lambda **kw: {"subject": "s", "predicate": "p", "description": "d", "object": "o", **kw}
    import json

    items = [item(), item(object=7), item(object=0), item(object=""), item(object="  "), item(subject=True),
             item(subject=False), item(predicate=None), item(description=[]), {"subject": "s"}]
    rows = spark.createDataFrame([(0, json.dumps(items))], "doc_id long, reply string")
    got = {(r.item_no, r.subject, r.object) for r in triples.parse_triplets(rows, "doc_id").collect()}
    assert got == {(0, "s", "o"), (1, "s", "7"), (4, "s", ""), (5, "True", "o")}


def test_first_triplet_wins_whatever_its_relation(spark):
    rows = spark.createDataFrame(
        [(3, "p3", "a", " D ", "b"), (1, "p1", "a", "d", "b"), (2, "p2", "a", "d", "c")],
        "ord long, predicate string, subject_key string, description string, object_key string")
    assert {r.ord for r in triples.dedup_triplets(rows).collect()} == {1, 2}


@pytest.mark.parametrize("k", [1, 2, 5])
def test_neighbourhood_search(spark, k):
    rng = np.random.default_rng(2)
    n = 60
    vec = rng.normal(size=(n, 6))
    # Entity 0 is part of a third of all triplets; texts repeat.
    trips = [
        (i, f"e{0 if i % 3 == 0 else rng.integers(1, 8)}", f"d{rng.integers(0, 4)}", f"e{rng.integers(1, 20)}")
        for i in range(n)
    ]
    q = rng.normal(size=(5, 6))
    rows = [(i, s, d, o, s, o, vec[i].tolist()) for i, s, d, o in trips]
    tdf = spark.createDataFrame(
        rows, "trip_id long, subject string, description string, object string, subject_key string, "
              "object_key string, embedding array<double>")
    qdf = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "qid long, vec array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = unit(q) @ unit(vec).T
    want = []
    for i in range(len(q)):
        hits = sorted(range(n), key=lambda j: (-round(s[i, j], 12), j))[:k]
        keys = {e for j in hits for e in (trips[j][1], trips[j][3])}
        text = lambda j: f"[{trips[j][1]}] {trips[j][2]} [{trips[j][3]}]"
        context = dict.fromkeys(map(text, hits))
        context.update(dict.fromkeys(text(j) for j in range(n) if trips[j][1] in keys or trips[j][3] in keys))
        want += [(i, r + 1, t) for r, t in enumerate(list(context)[: 4 * k])]
    got = sorted((r.qid, r["rank"], r.text) for r in vecgraph.vecgraph_search(tdf, qdf, k).collect())
    assert got == want
