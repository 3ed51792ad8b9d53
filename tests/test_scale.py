"""What keeps the work of one task bounded, and what only a cluster master shows."""

import numpy as np

from lodestone import catalog, session
from lodestone.operators import blocks, bm25, partners, simjoin


def _corpus(spark, folder, n):
    rows = [(i, f"alpha beta gamma-{i} delta") for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(folder)
    return spark.read.parquet(folder)


def test_pieces_of_text_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    docs = _corpus(spark, str(tmp_path / "docs"), 20_000)
    monkeypatch.setattr(session, "PIECE_BYTES", session.estimated_bytes(docs) // 50)
    assert bm25.tokenized(docs).rdd.getNumPartitions() >= 50
    monkeypatch.setattr(session, "PIECE_BYTES", 1 << 40)
    assert bm25.tokenized(docs).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_answers_on_a_cluster_master(spark, tmp_path, monkeypatch):
    """A master that is not local has no temporary folder that all executors share."""
    folder = str(tmp_path)
    _corpus(spark, f"{folder}/documents.parquet", 5)
    asked = spark.createDataFrame([(1, "gamma-3")], "item_id long, text string")
    asked.write.parquet(f"{folder}/benchmark.parquet")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    [row] = catalog.QUERIES["qa_answers"](spark, folder).collect()
    assert (row.answer, row.passages) == ("alpha beta gamma-3 delta", 1)


def test_copies_of_a_vector_meet_a_few_only(spark, monkeypatch):
    """Of a crowd of equal vectors only the first can be listed, so the others are never compared."""
    rows = [(i, [1.0, 0.0], False) for i in range(300)] + [(300, [0.9, 0.1], False)]
    vectors = spark.createDataFrame(rows, "id long, vec array<float>, settled boolean")
    placed = simjoin.place(vectors, 0.5)
    met = []
    whole = partners.block_join

    def seen(targets, visitors, *rest):
        met.append(visitors.count())
        return whole(targets, visitors, *rest)

    monkeypatch.setattr(partners, "block_join", seen)
    for nearest in (False, True):
        lists = partners.partner_lists(placed, placed.rows, placed.rows, 0.5, 4, nearest=nearest).collect()
        got = {r.id: ([c.cand for c in r.cands], r.more) for r in lists}
        assert got == {i: (list(range(min(i, 4))), i > 4) for i in range(1, 301)}
    assert met == [6, 6]


def test_slices_are_bounded_in_products():
    left, right = np.ones((600, 2)), np.ones((8192, 2))
    parts = list(blocks.similarity_slices(left, right))
    assert max(sims.size for _, sims in parts) <= 1 << 20
    assert [start for start, _ in parts] == list(np.cumsum([0] + [len(s) for _, s in parts])[:-1])
