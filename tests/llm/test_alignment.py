"""Alignment of two tokenizers against a token-by-token version, whole and in fragments."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import alignment
from lodestone.llm.catalog import TOKENIZERS

PATHS = (f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


def texts():
    r = random.Random(3)
    words = ["the", "Straße", "naïve", "x=1;", "日本語", "<|endoftext|>", "  ", "\n", "don't", "0xFF", "🙂", "señor", "aaaaaaaa", "12345"]
    made = [" ".join(r.choice(words) for _ in range(r.randrange(1, 40))) for _ in range(25)]
    return [None, "", " ", "▁", "a▁b", "\x00", "<s> </s> <unk>", "é" * 50, "word " * 900, made[0], made[0], *made, "".join(made) * 3]


def brute(rows):
    """Per row the columns of the operator, by walking both token sequences."""
    tok = alignment.Tokenizers.load(*PATHS)
    held, pairs_of = [], Counter()
    for text in rows:
        groups, links = [], Counter()
        if text:
            a = tok.a.encode(" " + text, add_special_tokens=False).ids
            b = tok.b.encode(text)
            raw = b" " + text.encode()
            if b"".join(tok.bytes_a[i] for i in a) == raw == b"".join(tok.bytes_b[i] for i in b):
                spans = []
                for ids, table in ((a, tok.bytes_a), (b, tok.bytes_b)):
                    at, out = 0, []
                    for i in ids:
                        out.append((at, at + len(table[i]), i))
                        at = out[-1][1]
                    spans.append(out)
                for byte in {e for side in spans for _, e, _ in side}:
                    held_by = [bisect.bisect_left(side, byte, key=lambda t: t[1]) for side in spans]
                    links[spans[0][held_by[0]][2], spans[1][held_by[1]][2]] += 1
                ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
                last = 0
                for end in ends:
                    near = [side[bisect.bisect_right(side, last, key=lambda t: t[1]) : bisect.bisect_right(side, end, key=lambda t: t[1])] for side in spans]
                    groups.append("|".join(",".join(str(i) for _, _, i in side) for side in near))
                    last = end
        links = +links
        pairs_of.update(links.keys())
        held.append((groups, links))
    top = defaultdict(int)
    for (i, _), n in pairs_of.items():
        top[i] = max(top[i], n)
    out = []
    for groups, links in held:
        said = ";".join(groups)
        out.append((
            sum(len(g.split("|")[0].split(",")) for g in groups), sum(len(g.split("|")[1].split(",")) for g in groups), len(groups),
            sum(links.values()), sum(n for p, n in links.items() if pairs_of[p] == top[p[0]]),
            sum(n * pairs_of[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if groups else "",
        ))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize(("chunk", "fan"), [(1 << 16, 16), (64, 3), (5, 2)])
def test_equals_token_by_token_version(spark, chunk, fan):
    rows = texts() if chunk > 5 else texts()[:16]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(rows)], "doc_id long, text string, row int, said string").repartition(5)
    got = alignment.aligned_documents(docs, *PATHS, chunk=chunk, fan=fan).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == brute(rows)


def test_links_by_a_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(alignment, "broadcast_if_small", lambda df, per_row: df.hint("merge"))
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    got = alignment.aligned_documents(docs, *PATHS).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == brute(texts())


def test_ids_may_be_null_or_repeat_and_tables_empty(spark):
    docs = spark.createDataFrame([(None, "some words"), (None, "some words"), (1, None), (1, "some words")], "doc_id long, text string")
    got = alignment.aligned_documents(docs, *PATHS).collect()
    assert len(got) == 4 and sorted(r.count_sum for r in got)[0] == 0 and len({r.groups_sha256 for r in got}) == 2
    assert alignment.aligned_documents(docs.limit(0), *PATHS).count() == 0


def test_joining_is_associative(spark):
    tok = alignment.Tokenizers.load(*PATHS)
    text = texts()[-1]
    tokens = tok.encode([text])[0]
    parts = [f for f, _ in alignment.fragments(tokens, tok, 7)]
    r = random.Random(1)

    def flat(f):
        return f.cut, *[tuple(map(int, x)) for x in (*f.prefix, *f.suffix)]

    want, closed = alignment.NEUTRAL, []
    for p in parts:
        want, g = alignment.joined(want, p)
        closed += [tuple(map(int, g[0]))] if g else []
    for _ in range(5):
        left, seen = list(parts), []
        while len(left) > 1:
            i = r.randrange(len(left) - 1)
            one, g = alignment.joined(left[i], left[i + 1])
            seen += [tuple(map(int, g[0]))] if g else []
            left[i : i + 2] = [one]
        assert flat(left[0]) == flat(want) and sorted(seen) == sorted(closed)
    assert flat(alignment.joined(alignment.NEUTRAL, want)[0]) == flat(want) == flat(alignment.joined(want, alignment.NEUTRAL)[0])


def test_byte_tables():
    assert alignment.byte_level("Ġthe") == b" the" and alignment.piece_bytes("<0x0A>") == b"\n" and alignment.piece_bytes("▁a") == b" a"
    assert sorted(alignment._byte_letters().values()) == list(range(256))
    assert np.all(alignment.Tokenizers.load(*PATHS).size_a > 0)


def test_encoder_by_rank_equals_the_file():
    tok = alignment.Tokenizers.load(*PATHS)
    assert tok.ranked is not None
    r = random.Random(4)
    latin = [chr(i) for i in range(256)]
    made = ["".join(r.choice(latin) for _ in range(r.randrange(1, 60))) for _ in range(4000)]
    made += ["".join(r.choice("aE'st dé\xa0\x85\t\n 1²!<|endoftext|>") for _ in range(r.randrange(1, 60))) for _ in range(4000)]
    assert [tok.ranked.encode_ordinary(t) for t in made] == [e.ids for e in tok.a.encode_batch(made, add_special_tokens=False)]
