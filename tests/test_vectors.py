import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import entities, knn, semantic_dedup, simjoin

RNG = np.random.default_rng(11)


def cloud(n=240, dim=8, centres=12, spread=0.25):
    """Clustered vectors with exact copies: a third of all rows is one vector."""
    c = RNG.normal(size=(centres, dim))
    v = c[RNG.integers(0, centres, n)] + spread * RNG.normal(size=(n, dim))
    v[RNG.permutation(n)[: n // 3]] = v[0]
    v[5] = 0.0
    v[17] = 0.0
    return v.astype(np.float32)


def frame(spark, v, col="embedding"):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], f"id long, {col} array<float>")


def sims(v):
    v = v.astype(np.float64)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    u = v / np.where(n == 0, 1, n)
    return np.round(u @ u.T, 12)


def small_cells(monkeypatch):
    monkeypatch.setattr(simjoin, "_CELL_ROWS", 20)
    monkeypatch.setattr(simjoin, "_BLOCK", 16)


def test_column_functions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [4.0, 3.0])], "a array<float>, z array<float>, b array<float>")
    r = row.select(
        V.l2_normalize(F.col("a")).alias("n"), V.l2_normalize(F.col("z")).alias("nz"),
        V.cosine(F.col("a"), F.col("b")).alias("c"), V.cosine(F.col("a"), F.col("z")).alias("cz"),
        V.similarity_from_cosine(F.lit(0.4)).alias("s"),
    ).first()
    assert r.n == pytest.approx([0.6, 0.8]) and r.nz == [0.0, 0.0]
    assert r.c == pytest.approx(0.96) and r.cz == 0.0 and r.s == pytest.approx(0.7)


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_knn_matches_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(knn, "_BLOCK", 50)
    v = cloud()
    s = sims(v)
    corpus = frame(spark, v, "vec")
    rows = knn.knn_search(corpus, corpus.withColumnRenamed("id", "qid"), 4, broadcast_bytes=limit).collect()
    want = {
        (q, r + 1, int(i)) for q in range(len(v))
        for r, i in enumerate(sorted(range(len(v)), key=lambda i: (-s[q, i], i))[:4])
    }
    assert {(r.qid, r["rank"], r.id) for r in rows} == want


def test_cutoff_is_inclusive_and_after_the_cut(spark):
    # Cosine distances 0.4 and 0.8 are similarities 0.8 and 0.6.
    v = [[0.6, 0.8], [0.2, float(np.sqrt(1 - 0.04))], [0.4, float(np.sqrt(1 - 0.16))]]
    corpus = spark.createDataFrame(list(enumerate(v)), "id long, vec array<double>")
    query = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, vec array<double>")
    assert [r.id for r in knn.vector_search(corpus, query, 3, 0.7).orderBy("rank").collect()] == [0, 2]
    assert [r.id for r in knn.vector_search(corpus, query, 1, 0.7).collect()] == [0]


def greedy(s, t):
    kept = []
    for j in range(len(s)):
        if not any(s[i, j] > t for i in kept):
            kept.append(j)
    return kept


@pytest.mark.parametrize("threshold", [0.5, 0.9, 0.98, -0.2])
@pytest.mark.parametrize("width", [1, 3, 32])
def test_dedup_equals_the_sequential_rule(spark, monkeypatch, threshold, width):
    small_cells(monkeypatch)
    v = cloud()
    got = semantic_dedup.semantic_dedup(frame(spark, v), threshold, width).where("kept").collect()
    assert sorted(r.id for r in got) == greedy(sims(v), threshold)


def test_dedup_of_a_chain_and_of_nothing(spark):
    # Neighbours are near, others are not: every second one stays.
    v = [[float(np.cos(i / 4)), float(np.sin(i / 4))] for i in range(12)]
    rows = spark.createDataFrame(list(enumerate(v)), "id long, embedding array<double>")
    got = semantic_dedup.semantic_dedup(rows, 0.93, 1).where("kept").orderBy("id").collect()
    assert [r.id for r in got] == list(range(0, 12, 2))
    assert semantic_dedup.semantic_dedup(rows.limit(0), 0.93).count() == 0


def test_dedup_of_an_addition_equals_a_full_run(spark):
    v = cloud()
    s = sims(v)
    first = [i for i in greedy(s[:150, :150], 0.9)]
    rows = frame(spark, v).where(F.col("id").isin(first) | (F.col("id") >= 150))
    rows = rows.withColumn("settled", F.col("id") < 150)
    got = semantic_dedup.semantic_dedup(rows, 0.9, width=2).where("kept").collect()
    assert sorted(r.id for r in got) == greedy(s, 0.9)


def test_pruned_join_visits_fewer_cells(spark, monkeypatch):
    small_cells(monkeypatch)
    placed = simjoin.place(frame(spark, cloud(), "vec"), 0.98)
    visits = placed.rows.agg(F.avg(F.size("visits"))).first()[0]
    assert 1 <= visits < placed.cells.count()


def sequential(names, s, pick, k, gate):
    owner, made = {}, []
    for j in range(len(names)):
        near = sorted((i for i in made), key=lambda i: -s[i, j])[:k]
        near = [i for i in near if s[i, j] >= gate]
        choice = pick(j, near)
        if near and choice:
            owner[j] = near[choice - 1]
        else:
            owner[j] = j
            made.append(j)
    return owner


@pytest.mark.parametrize(("gate", "width"), [(0.6, 32), (0.93, 32), (0.6, 4), (0.93, 1)])
def test_entities_equal_the_sequential_rule(spark, monkeypatch, gate, width):
    small_cells(monkeypatch)
    v = cloud(n=120)
    names = frame(spark, v).withColumn("name", F.concat(F.lit("n"), F.col("id").cast("string")))
    # The reply depends on the name and on how many candidates it is shown.
    reply = lambda name, cands: (
        (F.length(name) * 7 + F.size(cands) * 3 + F.ascii(F.substr(name, F.lit(2)))) % (F.size(cands) + 2)
    ).cast("string")

    def pick(j, near):
        r = (len(f"n{j}") * 7 + len(near) * 3 + ord(f"n{j}"[1])) % (len(near) + 2)
        return r if 1 <= r <= len(near) else 0

    got = {r.id: r.owner for r in entities.resolve_entities(names, reply, 3, gate, width).collect()}
    assert got == sequential(range(len(v)), sims(v), pick, 3, gate)


@pytest.mark.parametrize("choice", [0, 1])
def test_fixed_replies_take_no_round_per_member_of_a_group(spark, monkeypatch, choice):
    small_cells(monkeypatch)
    # A group of near copies: the nearest earlier names of each are other members, all merged into the first.
    v = np.concatenate([cloud(n=40), (np.ones(8) + 0.05 * RNG.normal(size=(30, 8))).astype(np.float32)])
    rounds, replies = [], []
    for module in (entities, semantic_dedup):
        counting = module.checkpoint_counting
        monkeypatch.setattr(module, "checkpoint_counting", lambda *a, c=counting: rounds.append(1) or c(*a))
    names = frame(spark, v).withColumn("name", F.col("id").cast("string")).withColumn("settled", F.col("id") < 2)
    got = entities.resolve_entities(names, entities.FixedReply(choice), 3, 0.8, 4, replies.append).collect()
    asked = []

    def pick(j, near):
        if near and j >= 2:
            asked.append(j)
        return choice if j >= 2 and choice <= len(near) else 0

    assert {r.id: r.owner for r in got} == sequential(range(len(v)), sims(v), pick, 3, 0.8) and len(got) == len(v)
    assert sum(r.count() for r in replies) == len(asked)
    assert len(rounds) < 15


def test_rows_that_repeat_an_id_with_a_fixed_reply(spark):
    """As by asking: a repeated name without earlier ones near stays twice, others are one."""
    vectors = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.8, 0.6]), (1, [0.8, 0.6]), (2, [0.28, 0.96]), (2, [0.28, 0.96])]
    names = spark.createDataFrame(vectors, "id long, embedding array<float>").withColumn("name", F.lit("n"))
    asked = entities.resolve_entities(names, lambda name, cands: F.lit("1"), 3, 0.75).collect()
    got = entities.resolve_entities(names, entities.always_nearest, 3, 0.75).collect()
    assert sorted(got) == sorted(asked) == [(0, 0), (0, 0), (1, 0), (2, 2)]


def test_no_merge_without_a_gate_or_a_choice(spark):
    names = frame(spark, cloud(n=30)).withColumn("name", F.col("id").cast("string"))
    for selector, gate in ((entities.always_nearest, 0.0), (entities.never_merge, 0.5)):
        rows = entities.resolve_entities(names, selector, 5, gate).collect()
        assert len(rows) == 30 and all(r.id == r.owner for r in rows)


def test_candidates_exclude_the_name_itself(spark):
    v = cloud(n=60)
    s = sims(v)
    rows = entities.entity_candidates(frame(spark, v), 3, 0.8).collect()
    want = {
        (j, r + 1, i) for j in range(60) for r, i in enumerate(
            sorted((i for i in range(60) if i != j and s[i, j] >= 0.8), key=lambda i: (-s[i, j], i))[:3])
    }
    assert {(r.id, r["rank"], r.cand) for r in rows} == want
