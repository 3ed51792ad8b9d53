"""All stages of the corpus pipeline on a small table, each against a plain version of its rule."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from lodestone.llm.common import plain_words, space_words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


_RANDOM = random.Random(0)
# Words that share no beginnings to speak of, so chance makes none of them a lexicon term.
VOCABULARY = ["".join(_RANDOM.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(4000)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t else 0) for i, t, s in rows], SCHEMA)


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


@pytest.fixture
def folder(spark, tmp_path):
    """A corpus with toxic words, repeated lines, near copies, benchmark passages and odd rows."""
    item = prose(900, 30)
    line = "this very line of ten plain words stands in many texts"
    rows = [(i, prose(i, 60), f"s{i % 3}") for i in range(40)]
    rows += [(100 + i, prose(300 + i, 40) + " youfool", "s0") for i in range(16)]
    rows += [(200 + i, prose(500 + i, 40) + "\n" + line, "s1") for i in range(4)]
    rows += [(300, prose(1, 59), "s2"), (301, prose(2, 59), None), (400, prose(700, 50) + " " + item, "s2")]
    rows += [(1, prose(801, 50), "s0"), (None, prose(802, 50), "s0"), (None, prose(802, 50), "s0"), (500, None, "s1"), (501, "", None)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 1) for i in range(16)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def shingles(text):
    words = space_words(text.encode() if text else None)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def near_groups(rows):
    """One row of every group of rows that are linked directly or by others."""
    sets, groups = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while groups[i] != i:
            i = groups[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                groups[find(i)] = find(j)
    members = {}
    for i, row in enumerate(rows):
        members.setdefault(find(i), []).append(row)
    return sorted((min(m, key=lambda r: (r[0] is None, r[0] or 0)) for m in members.values()), key=repr)


def test_rows_of_one_id_are_judged_each_for_itself(spark):
    a, b, c = (prose(s, 40) for s in (1, 2, 3))
    rows = [(3, a, "s"), (5, a, "s"), (5, b, "s"), (7, c, "s"), (7, c, "s"), (None, c, "s"), (None, "", "s"), (8, None, "s")]
    got = kept(corpus_pipeline.drop_near_duplicates(spark, table(spark, rows), ""))
    assert got == sorted([(3, a), (5, b), (7, c), (None, ""), (8, None)], key=repr)


def test_stages_on_a_small_corpus(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept(docs)
        out = stage(spark, docs, folder)
        assert out.columns == COLUMNS
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        after = kept(docs)
        if name == "toxicity":
            assert after == [r for r in before if "youfool" not in (r[1] or "")]
        elif name == "line_dedup":
            line = "this very line of ten plain words stands in many texts"
            # Rows without an id are not compared with each other here; the next stage tells them apart.
            assert sum(line in (t or "") for _, t in after) == 1 and len(after) == len(before)
            assert {r for r in before if line not in (r[1] or "")} <= set(after)
        elif name == "near_dedup":
            assert after == near_groups(before)
        else:
            item = plain_words(prose(900, 30).encode())
            assert not any(" ".join(w.decode() for w in item[:13]) in (t or "") for _, t in after)
            assert len(after) >= len(before) - 1
    name, mix = corpus_pipeline.STAGES[-1]
    taken = mix(spark, docs, folder).collect()
    sizes = Counter(r.doc_id for r in taken)
    assert sum(sizes.values()) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in taken)


def test_stages_on_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_run_gives_the_rows_of_the_last_stage(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and len({r.doc_id for r in rows}) > 30 and not any(r.doc_id is not None and 100 <= r.doc_id < 116 for r in rows)
