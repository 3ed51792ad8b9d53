"""Edge cases and brute-force comparisons of the training-data operators on small fixtures."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bottomk, decontam, licences, linededup, mixing, passages, sanitise, topk, toxicity, warc
from lodestone.llm.components import connected

DOCS = "doc_id long, text string, source string, n_chars long, score double, key string"


def docs(spark, rows):
    """Documents with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, s, len(t or ""), 1.0, "k") for i, t, s in rows], DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("w" + str(r.randrange(5000)) for _ in range(n))


ODD = [(1, None, "a"), (2, "", "a"), (3, "  \n ", None), (None, "lonely words here", None), (4, "x" * 50_000, "b")]


def test_odd_rows_and_empty_tables(spark):
    odd, none = docs(spark, ODD + [ODD[4]]), docs(spark, [])
    items = spark.createDataFrame([(1, "some item"), (None, "x"), (2, None)], "item_id long, text string")
    assert bottomk.near_duplicates(odd).count() == 6 and bottomk.near_duplicates(none).count() == 0
    assert sanitise.scan(odd).count() == 6 and sanitise.scan(none).count() == 0
    assert licences.scan(odd).count() == 6 and licences.scan(none).count() == 0
    assert decontam.matches(odd, items).count() == 6 and decontam.matches(none, items.limit(0)).count() == 0
    assert linededup.without_repeats(odd).count() == 6 and linededup.without_repeats(none).count() == 0
    assert mixing.taken(odd).count() == 6 and mixing.taken(none).count() == 0
    assert passages.repeated_passages(odd).count() == 0 and passages.repeated_passages(none).count() == 0
    assert decontam.cleaned(odd, items).columns == odd.columns
    labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(odd, labels)
    assert toxicity.scored(odd, model).where("score between 0 and 1 and predicted = 0").count() == 6
    assert toxicity.scored(none, model).count() == 0


def test_levenshtein_automaton():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j] + 1, row[j + 1] + 1, last + (x != y))
        return row[-1]

    r = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(7))) for _ in range(2))
        automaton = toxicity.LevenshteinAutomaton(a, 2)
        state = automaton.start()
        for letter in b:
            state = automaton.step(state, letter)
        want = distance(a, b)
        assert automaton.distance(state) == (want if want <= 2 else None)


def test_misspelled_and_quoted_terms():
    lexicon = toxicity.Lexicon({"worthless": 8.0, "idiot": 8.0}, {})
    matches = toxicity._Matches(lexicon)
    assert lexicon.match("worthles") == (8.0, True) and lexicon.match("wrthlesss") == (8.0, True)
    assert lexicon.match("idiom") == (8.0, True) and lexicon.match("idyll") is None
    plain, quoted = (toxicity.features(t, matches) for t in ("you idiot go", 'they wrote "you idiot go" there'))
    assert quoted[0] < plain[0] and quoted[3] == 1.0 and plain[3] == 0.0


def test_topk_equals_brute_force(spark):
    r = random.Random(2)
    rows = [(i, [r.randrange(-3, 4) / 8 for _ in range(4)]) for i in range(120)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(5000, None), (5001, [float("nan")] * 4), (5002, [None] * 4)]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [tuple(x) for x in topk.search(v, v.where("vec_id % 20 = 0"), 7).orderBy("query_id", "rank").collect()]
    import math

    known = {i: [math.floor(64 * c) for c in e] for i, e in rows[:150]}
    want = []
    for q in sorted(k for k in known if k % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(known[q], c, strict=True)), i) for i, c in known.items() if i != q)[:7]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want


def test_near_duplicates(spark):
    base = prose(1, 200).split()
    near = base[:]
    near[100] = "changed"
    far = base[:120] + prose(2, 80).split()
    rows = [(5, " ".join(base), "a"), (3, " ".join(near), "a"), (9, " ".join(base).upper(), "a"), (7, " ".join(far), "a"), (8, "tiny", "a"), (2, "tiny", "b")]
    got = {r.doc_id: (r.component_id, r.kept) for r in bottomk.near_duplicates(docs(spark, rows)).collect()}
    assert got == {5: (3, False), 3: (3, True), 9: (3, False), 7: (7, True), 8: (2, False), 2: (2, True)}


def test_crowds_of_near_copies_equal_brute_force(spark, monkeypatch):
    # Small blocks, so that lists meet themselves over several of them.
    monkeypatch.setattr(bottomk, "_BLOCK", 8)
    monkeypatch.setattr(bottomk, "_OFFERS", (1, 2, 8))
    rng = random.Random(4)
    texts = []
    for crowd in range(3):
        base = [f"c{crowd}w{i}" for i in range(120)]
        for _ in range(40):
            copy = base[:]
            for at in rng.sample(range(120), rng.randint(0, 6)):
                copy[at] = f"x{rng.randrange(30)}"
            texts.append(" ".join(copy))
    sets = []
    for t in texts:
        words = t.split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    root, before = list(range(len(texts))), None
    while root != before:
        before = root[:]
        for i, a in enumerate(sets):
            for k in range(i):
                if len(a & sets[k]) * 100 >= 80 * len(a | sets[k]):
                    root[i] = root[k] = min(root[i], root[k])
    assert 6 < len(set(root)) < 110
    got = bottomk.near_duplicates(docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))


def test_lists_of_one_block_are_not_copied(spark):
    """Members of two lists, half of each settled: copies for the blocks of the other side only beyond one block."""
    for size in (700, 2800):
        rows = spark.range(size).selectExpr(
            "id AS node", "1L AS value", f"{size} AS size", f"{size // 2} AS settled_size", "id % 2 = 0 AS settled"
        )
        assert bottomk._meetings(rows, inside=False).count() == size


def test_overlaps_by_slices_equal_brute_force(monkeypatch):
    monkeypatch.setattr(bottomk, "_ROWS", 4)
    monkeypatch.setattr(bottomk, "_COLUMNS", 8)
    r = np.random.default_rng(2)
    sketches = [np.unique(r.integers(0, 90, 20)) for _ in range(30)]
    rows = np.arange(1, 30, 2)
    some, common = zip(*bottomk._overlaps(sketches, rows), strict=True)
    assert np.concatenate(some).tolist() == rows.tolist() and max(len(x) for x in some) == 4
    want = [[len(np.intersect1d(sketches[a], b)) for b in sketches] for a in rows]
    assert np.array_equal(np.concatenate(common), want)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    roots = dict(connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert roots == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_identifiers_and_disclosing_terms(spark):
    card = "4111 1111 1111 1111"
    text = f"write a.b@c.de, a@b.c@d.e or 1.2.3.4 999.1.1.1 {card} and +49 (30) 1234567."
    email, ip, cards, phone = sanitise.base_spans(text)
    assert [text[a:b] for a, b in email] == ["a.b@c.de", "a@b.c"]
    assert [text[a:b] for a, b in ip] == ["1.2.3.4"] and len(phone) == 1
    assert all(sanitise.luhn(sanitise._digits(text[a:b])) for a, b in cards)
    rows = [(i, f"{prose(i, 30)} the gardener zelda reached at z@gard.en today", "a") for i in range(4)]
    rows += [(10 + i, "the weather today " + " ".join("abcdefgh"[(i + j) % 8] * 5 for j in range(6)), "a") for i in range(600)]
    rows += [(999, "zelda moved", "a")]
    clean = {r.doc_id: r.text for r in sanitise.sanitised(docs(spark, rows)).collect()}
    assert "[EMAIL]" in clean[0] and "zelda" not in clean[0] and "zelda" not in clean[999]
    assert clean[10] == rows[4][1]


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "u", "é" * 600), (2, "u", "é" * 600), (3, None, None), (4, "v", "a" * 999), (5, "v", "a" * 999), (5, "w", "b\r\n\r\nWARC/1.0" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    want = set()
    for i, _, h in rows:
        b = (h or "").encode()
        want.add((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if i == 1 else "response", 2 if i == 1 else None))
    assert got == want
    path = f"file://{tmp_path}/a"
    warc.write_pages(pages, path)
    read = warc.read_archives(spark, path, payload=False)
    assert read.where("record_type = 'revisit'").select("record_id", "payload").collect() == [("1", None)]
    assert read.where(F.col("target_uri").isin("v", "w")).count() == 3


def test_licence_expressions():
    both = licences.choices("MIT OR (Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0)")
    assert both == [frozenset(["mit"]), frozenset(["apache-2.0", "gpl-2.0-only with classpath-exception-2.0"])]
    assert licences.choices("") == [] and licences.choices("AND MIT") == []
    assert licences.choices("MIT and") == [frozenset(["mit"])]
    text = "the MIT license, MIT License;\nSPDX-License-Identifier: BSD-3-Clause\n".encode()
    words, n, first, last, base, labels, score, _ = licences.read(text, licences._automaton())
    assert (words, n, first, last, base, labels, score) == (11, 2, 1, 3, "mit", "bsd-3-clause,mit", 1.0)


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, prose(i, r.randrange(1, 300)), r.choice(["a", "b", "c", None])) for i in range(200)]
    got = mixing.taken(docs(spark, rows)).collect()
    again = mixing.taken(docs(spark, rows)).collect()
    assert sorted(got) == sorted(again) and len(got) == 200 and all(x.taken <= 2 * x.size for x in got)
    by = {}
    source = {i: s for i, _, s in rows}
    for x in got:
        taken, target, size = by.get(source[x.doc_id], (0, 0, 0))
        by[source[x.doc_id]] = (taken + x.taken, x.target, x.source_size)
    assert all(abs(taken - target) <= mixing.BLOCK_WORDS for taken, target, _ in by.values())
    assert sum(t for _, t, _ in by.values()) == pytest.approx(1.5 * sum(s for _, _, s in by.values()))
    for n in (1, 2, 7, 100):
        column = mixing.shuffled(F.col("id"), F.lit(n), F.lit(5))
        assert sorted(x[0] for x in spark.range(n).select(column).collect()) == list(range(n))


def test_line_runs(spark):
    run = ["one line", "two line", "three line", "four line"]
    rows = [(1, "\n".join(["start", *run, "end"]), "a"), (2, "\n".join(["other", "", *run, "last"]), "a"), (3, "one line\nalone", "a")]
    got = {r.doc_id: (r.text, r.asDict()["__removed"]) for r in linededup.without_repeats(docs(spark, rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("other\n\nlast", 4), 3: (rows[2][1], 0)}


def test_contamination(spark):
    item = prose(9, 30)
    rows = [(1, prose(1, 40) + " " + item.upper() + " " + prose(2, 40), "a"), (2, prose(3, 50), "a"), (3, item, "a")]
    items = spark.createDataFrame([(7, item), (8, "w1 short"), (None, prose(3, 50))], "item_id long, text string")
    found = {r.doc_id: r for r in decontam.judged(decontam.matches(docs(spark, rows), items)).collect()}
    sharded = {r.doc_id: r for r in decontam.judged(decontam.matches(docs(spark, rows), items, shard_words=16)).collect()}
    assert found == sharded and [found[i].n_hit for i in (1, 2, 3)] == [30, 0, 30]
    clean = {r.doc_id: r.text for r in decontam.cleaned(docs(spark, rows), items).collect()}
    assert clean == {1: prose(1, 40) + "  " + prose(2, 40), 2: rows[1][1]}


def test_passages(spark):
    shared = prose(5, 80).split()
    fuzzy = shared[:]
    fuzzy[20] = "edit"
    del fuzzy[50]
    rows = [(1, f"{prose(1, 60)} {' '.join(shared)}", "a"), (4, f"{' '.join(shared)} {prose(2, 50)}", "a"), (6, f"{prose(3, 9)} {' '.join(fuzzy)}", "a"), (7, prose(4, 100), "a")]
    got = {r.doc_id: r for r in passages.repeated_passages(docs(spark, rows)).collect()}
    assert set(got) == {4, 6} and (got[4].start, got[4].end, got[4].source_id, got[4].source_start) == (0, 80, 1, 60)
    assert got[6].source_id == 1 and got[6].start == 9 and got[6].n_equal == 78


def test_passages_around_a_gap(spark):
    rows, want = [], []
    for n, (size, gap) in enumerate([(60, 60), (200, 300), (400, 800), (60, 45)]):
        first, second = prose(10 + n, size), prose(20 + n, size)
        # The gap differs in length too for every other pair.
        rows.append((10 * n, f"{first} {prose(30 + n, gap)} {second}", "a"))
        rows.append((10 * n + 1, f"{first} {prose(40 + n, gap + n % 2 * 7)} {second}", "a"))
        want += [(10 * n + 1, 0, size, 0), (10 * n + 1, size + gap + n % 2 * 7, 2 * size + gap + n % 2 * 7, size + gap)]
    got = passages.repeated_passages(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.start, r.end, r.source_start) for r in got) == want
    assert all(r.source_id == r.doc_id - 1 and r.identity == 1.0 for r in got)


def test_pieces_of_a_chain():
    # Two short runs with an insertion are one passage; a run of 0.7 holds one of 0.8.
    both = passages._beside([True] * 68)
    both[30:38] = (1, 0, 0)
    assert passages.pieces(both, [0, 38], 50, 0.8) == [(0, 68)]
    thin = passages._beside([i % 10 < 6 for i in range(100)] + [i % 10 != 9 for i in range(60)])
    (piece,) = passages.pieces(thin, [0], 50, 0.8)
    assert piece[0] >= 60 and piece[1] == 159


def test_lone_lines_and_pairs(spark):
    long, word = prose(50, 50), "twenty"
    rows = [
        (1, long, "a"), (2, f"own start\n{long}\nown end", "a"), (3, long, "a"),
        # Every pair of repeated lines goes, wherever its lines alone stand first.
        (4, "p one\nelse", "a"), (5, "q two\nmore", "a"), (6, "x\np one\nq two\ny", "a"), (7, "v\np one\nq two\nw", "a"),
        (8, word, "a"), (9, word, "a"),
    ]
    got = {r.doc_id: (r.text, r.asDict()["__removed"]) for r in linededup.without_repeats(docs(spark, rows)).collect()}
    want = {i: (t, 0) for i, t, _ in rows} | {2: ("own start\nown end", 1), 3: ("", 1), 7: ("v\nw", 2)}
    assert got == want


def test_repeated_lines_equal_brute_force(spark):
    r = random.Random(6)
    pool = [prose(100 + i, r.choice([1, 2, 12])) for i in range(14)]
    rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.5 else prose(1000 + 20 * i + j, 3) for j in range(r.randrange(1, 9))), "a") for i in range(60)]
    seen, want = set(), {}
    for i, text, _ in rows:
        lines = text.split("\n")
        gone = set()
        for at, line in enumerate(lines):
            for gram in ([(line,)] if len(line.split()) >= linededup.WORDS else []) + [tuple(lines[at : at + 2])] * (at + 1 < len(lines)):
                if gram in seen:
                    gone.update(range(at, at + len(gram)))
                seen.add(gram)
        want[i] = "\n".join(x for at, x in enumerate(lines) if at not in gone)
    got = {r.doc_id: r.text for r in linededup.without_repeats(docs(spark, rows)).collect()}
    assert got == want and got != {i: t for i, t, _ in rows}


def test_misspelled_weak_terms_and_stems():
    lexicon = toxicity.Lexicon({"worthless": 8.0, "numbskull": 4.0}, {"pathet": 5.0})
    assert lexicon.match("numbskul") == (4.0, True) and lexicon.match("pathetically") == (5.0, False)
    assert lexicon.match("pahetically") == (5.0, True) and lexicon.match("pxthetic") == (5.0, True)
    assert lexicon.match("sympathetic") is None and lexicon.match("path") is None


def test_hits_count_their_neighbours_in_long_texts():
    matches = toxicity._Matches(toxicity.Lexicon({"idiot": 8.0}, {}))
    few, many = (toxicity.features("idiot " * n, matches) for n in (150, 400))
    assert few[0] == many[0] == pytest.approx(0.8 * 1.5)


def test_misspellings_keep_a_share_of_their_term(spark):
    rows = [(f"{prose(i, 20)} worthles thing", 1) for i in range(20)] + [(f"{prose(100 + i, 20)} idiom thing", 0) for i in range(80)]
    lexicon = toxicity.Lexicon({"worthless": 8.0, "idiot": 8.0})
    lexicon = toxicity.with_shares(lexicon, spark.createDataFrame(rows, "text string, toxic int"))
    assert lexicon.match("worthles")[0] > 7.5 and lexicon.match("idiom") is None and lexicon.match("idiot") == (8.0, False)


def test_long_and_wrapped_licence_expressions():
    automaton = licences._automaton()
    ids = [f"lic-{i}" for i in range(200)]
    text = f"SPDX-License-Identifier: {' OR '.join(ids)}\nmore"
    assert set(licences.read(text.encode(), automaton)[5].split(",")) == set(ids)
    text = "// SPDX-License-Identifier: (MIT OR\n//   Apache-2.0) AND\n// BSD-3-Clause"
    assert licences.read(text.encode(), automaton)[5:] == ("apache-2.0,mit", 1.0, ["mit or apache-2.0"])
    text = "SPDX-License-Identifier: " + " AND ".join(f"(a{i} OR b{i})" for i in range(60))
    labels, _, (expression,) = licences.read(text.encode(), automaton)[5:]
    assert len(labels.split(",")) == 120 and expression.startswith("(a0 or b0) and (a1 or b1) and ")
    text = "SPDX-License-Identifier: (GPL-2.0-only OR MIT) WITH Classpath-exception-2.0"
    assert licences.read(text.encode(), automaton)[5] == "gpl-2.0-only with classpath-exception-2.0,mit with classpath-exception-2.0"
