"""Alignment of two tokenizers over the same texts, by a monoid of fragments.

Both tokenizers cut the bytes of a text.  Where tokens of both end at one offset the text is cut
into groups; a group is a shortest run of bytes that whole tokens of both sides cover.

A fragment stands for a range of bytes.  Without a common end in the range it is open: the tokens
that end there, to be joined to what comes before and after.  Otherwise it is an open prefix (the
tokens up to the first common end), closed groups, and an open suffix (the tokens after the last).
Joining two fragments closes at most one group, made of a suffix and a prefix; joining is
associative and the empty fragment is neutral, so fragments may be joined in any tree.

Texts up to a chunk are one fragment.  Longer ones become fragments of a chunk of bytes each, which
give away their closed groups at once; only open ends travel, and are joined in rounds of
neighbours across tasks.  All tokens of a text are found in one task, as merges of a piece
tokenizer may look at all of a text.

Tokens link where their bytes overlap.  How many documents hold a linked pair of ids is counted
over the whole corpus by map-side aggregation, and judged per document in a second join.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import lists, utf8
from lodestone.session import broadcast_if_small, checkpoint

# Bytes of a fragment; texts up to it are aligned as a whole.
CHUNK = 1 << 16
# Neighbours joined in one round.
FAN = 16
# Texts are tokenized by so many bytes, longer ones alone.
_BATCH = 1 << 20

_IDS = pa.list_(pa.int32())


def _byte_letters() -> dict[str, int]:
    """The letters byte-level vocabularies write bytes with: printable ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def byte_level(entry: str) -> bytes:
    return bytes(map(_LETTERS.__getitem__, entry))


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


# How byte-level BPE of this family cuts a text before merging; fixed values.
_BEFORE_MERGES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _by_rank(path: str):
    """An encoder that merges by id, several times as fast; None where the file's merges do not go by id."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    model, before = held["model"], held["pre_tokenizer"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    vocabulary = model["vocab"]
    ranks = [vocabulary.get(m) for m in merged]
    plain = before == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if not plain or held["normalizer"] is not None or None in ranks or any(x >= y for x, y in zip(ranks, ranks[1:], strict=False)):
        return None
    special = {t["content"] for t in held["added_tokens"]}
    by_rank = {byte_level(t): i for t, i in vocabulary.items() if t not in special}
    if len(by_rank) != 256 + len(merged) or any(bytes([i]) not in by_rank or by_rank[bytes([i])] > ranks[0] for i in range(256)):
        return None
    return tiktoken.Encoding("by_rank", pat_str=_BEFORE_MERGES, mergeable_ranks=by_rank, special_tokens={})


def _table(entries: list[str]) -> np.ndarray:
    return np.array([e.encode() for e in entries])


@dataclass
class Tokenizers:
    """Two tokenizers of a worker; ``bytes_a`` and ``bytes_b`` are the bytes of each id."""

    a: object
    b: object
    bytes_a: list[bytes]
    bytes_b: list[bytes]
    ranked: object = None

    def __post_init__(self) -> None:
        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        # Ids followed by each separator, for the digest of groups: those of side a, then those of b.
        said = [f"{i}{s}" for i in range(len(self.bytes_a)) for s in ",|"]
        said += [f"{i}{s}" for i in range(len(self.bytes_b)) for s in ",;"]
        self.said, self.said_size = _table(said), np.array([len(x) for x in said])
        self.said_b = 2 * len(self.bytes_a)

    @classmethod
    def load(cls, path_a: str, path_b: str) -> Tokenizers:
        """From a byte-level BPE file and a piece model, installed on every worker."""
        # A task is one thread; the pool of this library would take the cores of others.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(path_a)
        a.encode_special_tokens = True
        b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        special = {i for i, t in a.get_added_tokens_decoder().items() if t.special}
        entries = [a.id_to_token(i) for i in range(a.get_vocab_size())]
        of_a = [t.encode() if i in special else byte_level(t) for i, t in enumerate(entries)]
        of_b = [piece_bytes(b.id_to_piece(i)) for i in range(b.get_piece_size())]
        return cls(a, b, of_a, of_b, _by_rank(path_a))

    def encode_a(self, text: str) -> list[int]:
        """Letters are told from other characters alike by both encoders up to U+00FF; beyond, tables may differ in age."""
        if self.ranked is not None and (text.isascii() or len(text.encode("latin-1", "ignore")) == len(text)):
            return self.ranked.encode_ordinary(text)
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides per text; None where the bytes of a side are not those of space and text."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            raw = b" " + text.encode()
            if b"".join(map(self.bytes_b.__getitem__, b)) != raw:
                out.append(None)
                continue
            a = self.encode_a(" " + text)
            same = b"".join(map(self.bytes_a.__getitem__, a)) == raw
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if same else None)
        return out


@dataclass
class Fragment:
    """Tokens of a range of bytes outside closed groups; without a cut all of them are in the prefix.

    ``cut`` is the number of the chunk with the first common end, None without any.
    """

    cut: int | None
    prefix: tuple[np.ndarray, np.ndarray]
    suffix: tuple[np.ndarray, np.ndarray]


Tokens = tuple[np.ndarray, np.ndarray]
_NONE = np.zeros(0, np.int64)
NEUTRAL = Fragment(None, (_NONE, _NONE), (_NONE, _NONE))


def _glued(x: Tokens, y: Tokens) -> Tokens:
    return np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])


def joined(x: Fragment, y: Fragment) -> tuple[Fragment, Tokens | None]:
    """Two neighbours as one fragment, and the group this closes, if any; it ends in chunk ``y.cut``."""
    if x.cut is None:
        return Fragment(y.cut, _glued(x.prefix, y.prefix), y.suffix), None
    if y.cut is None:
        return Fragment(x.cut, x.prefix, _glued(x.suffix, y.prefix)), None
    return Fragment(x.cut, x.prefix, y.suffix), _glued(x.suffix, y.prefix)


@dataclass
class Groups:
    """What closed groups add up to: counts, the digest's text, and distinct pairs with their links."""

    n_a: int
    n_b: int
    n_groups: int
    said: bytes
    a: np.ndarray
    b: np.ndarray
    links: np.ndarray


def _last(groups: np.ndarray) -> np.ndarray:
    """Whether a token is the last of its group."""
    return np.append(groups[1:] != groups[:-1], True)[: len(groups)]


def aligned(parts: list[Tokens], tok: Tokenizers) -> list[Groups]:
    """Each of ``parts`` covers whole groups; all are aligned in one pass over their bytes end to end."""
    count = len(parts)
    sizes_a, sizes_b = ([len(p[i]) for p in parts] for i in (0, 1))
    a = np.concatenate([p[0] for p in parts]) if parts else _NONE
    b = np.concatenate([p[1] for p in parts]) if parts else _NONE
    end_a, end_b = np.cumsum(tok.size_a[a]), np.cumsum(tok.size_b[b])
    # Whether a token of a side ends at an offset; running sums number tokens and groups.
    size = int(end_a[-1]) + 1 if len(a) else 1
    is_a, is_b = np.zeros(size, bool), np.zeros(size, bool)
    is_a[end_a] = True
    is_b[end_b] = True
    both = is_a & is_b
    closed = np.cumsum(both, dtype=np.int32)
    group_a, group_b = closed[end_a] - both[end_a], closed[end_b] - both[end_b]
    count_a, count_b = np.cumsum(is_a, dtype=np.int32), np.cumsum(is_b, dtype=np.int32)
    # A group reads as its tokens of one side, then those of the other.
    cuts = np.flatnonzero(both)
    before = np.concatenate([[0], count_b[cuts]])
    through = count_a[cuts]
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + before[group_a]] = 2 * a + _last(group_a)
    codes[np.arange(len(b)) + through[group_b]] = tok.said_b + 2 * b + _last(group_b)
    said = tok.said[codes].tobytes().replace(b"\0", b"")
    said_at = np.concatenate([[0], np.cumsum(tok.said_size[codes])])
    # Between two neighbouring ends of either side lies the overlap of one token of each.
    ends = np.flatnonzero(is_a | is_b)
    link_a, link_b = a[count_a[ends] - is_a[ends]], b[count_b[ends] - is_b[ends]]
    stop_a, stop_b = np.cumsum(sizes_a, dtype=np.int64), np.cumsum(sizes_b, dtype=np.int64)
    finish = end_a[stop_a - 1] if count else _NONE
    part = np.searchsorted(finish, ends)
    key = np.sort((part << 40) | (link_a << 20) | link_b)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    key, links = key[first], np.diff(np.append(first, len(key)))
    borders = np.searchsorted(key >> 40, np.arange(count + 1))
    groups_at = closed[finish] if count else _NONE
    out = []
    for i in range(count):
        lo, hi = borders[i], borders[i + 1]
        begin = said_at[stop_a[i - 1] + stop_b[i - 1]] if i else 0
        text = said[begin : said_at[stop_a[i] + stop_b[i]] - 1]
        n_groups = int(groups_at[i] - (groups_at[i - 1] if i else 0))
        out.append(Groups(
            sizes_a[i], sizes_b[i], n_groups, text, (key[lo:hi] >> 20) & 0xFFFFF, key[lo:hi] & 0xFFFFF, links[lo:hi]
        ))
    return out


def fragments(tokens: Tokens, tok: Tokenizers, chunk: int) -> list[tuple[Fragment, Tokens]]:
    """A text's tokens by ranges of ``chunk`` bytes: the open ends, and the tokens of closed groups."""
    a, b = tokens
    end_a, end_b = np.cumsum(tok.size_a[a]), np.cumsum(tok.size_b[b])
    count = -(-int(end_a[-1]) // chunk)
    marks = np.arange(1, count + 1) * chunk
    at_a = np.concatenate([[0], np.searchsorted(end_a, marks, side="right")])
    at_b = np.concatenate([[0], np.searchsorted(end_b, marks, side="right")])
    out = []
    for i in range(count):
        here_a, here_b = slice(at_a[i], at_a[i + 1]), slice(at_b[i], at_b[i + 1])
        cuts = np.intersect1d(end_a[here_a], end_b[here_b], assume_unique=True)
        if not len(cuts):
            out.append((Fragment(None, (a[here_a], b[here_b]), (_NONE, _NONE)), (_NONE, _NONE)))
            continue
        (p_a, s_a), (p_b, s_b) = (
            at[i] + np.searchsorted(end[at[i] : at[i + 1]], cuts[[0, -1]], side="right")
            for end, at in ((end_a, at_a), (end_b, at_b))
        )
        out.append((
            Fragment(i, (a[at_a[i] : p_a], b[at_b[i] : p_b]), (a[s_a : at_a[i + 1]], b[s_b : at_b[i + 1]])),
            (a[p_a:s_a], b[p_b:s_b]),
        ))
    return out


_CLOSED = "n_a long, n_b long, n_groups long, n_links long, said string, a array<int>, b array<int>, links array<int>"
_OPEN = "cut int, prefix_a array<int>, prefix_b array<int>, suffix_a array<int>, suffix_b array<int>"
# ``chunks`` is the number of fragments of the text, 0 for texts without tokens; ``place`` orders what they say.
_SCHEMA = f"row long, doc_id long, chunks int, chunk int, place int, {_CLOSED}, {_OPEN}"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _closed(g: Groups, digest: bool) -> list:
    said = hashlib.sha256(g.said).hexdigest() if digest else g.said.decode()
    return [g.n_a, g.n_b, g.n_groups, int(g.links.sum()), said, g.a, g.b, g.links]


def _open(f: Fragment | None) -> list:
    return [None, *[_NONE] * 4] if f is None else [f.cut, *f.prefix, *f.suffix]


_NOTHING = [0, 0, 0, 0, "", _NONE, _NONE, _NONE]
_TYPES = [
    pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.string(), *[_IDS] * 3, pa.int32(), *[_IDS] * 4,
]


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = ([r[i] for r in rows] for i in range(len(_TYPES)))
    return pa.RecordBatch.from_arrays(
        [lists(c, pa.int32()) if t == _IDS else pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES
    )


def _aligned_texts(path_a: str, path_b: str, chunk: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizers.load(path_a, path_b)

        def flush(held: list[tuple[int, int | None, bytes]]) -> Iterator[pa.RecordBatch]:
            found = tok.encode([t.decode("utf-8", "replace") for _, _, t in held])
            rows: list[list] = []
            short: list[tuple[int, int | None, Tokens]] = []
            for (row, doc, text), tokens in zip(held, found, strict=True):
                if tokens is None:
                    rows.append([row, doc, 0, 0, 0, *_NOTHING, *_open(None)])
                elif len(text) < chunk:
                    short.append((row, doc, tokens))
                else:
                    pieces = fragments(tokens, tok, chunk)
                    full = [i for i, (_, inner) in enumerate(pieces) if len(inner[0])]
                    groups = dict(zip(full, aligned([pieces[i][1] for i in full], tok), strict=True))
                    for i, (open_ends, _) in enumerate(pieces):
                        inside = _closed(groups[i], False) if i in groups else _NOTHING
                        rows.append([row, doc, len(pieces), i, 1, *inside, *_open(open_ends)])
            for (row, doc, _), g in zip(short, aligned([t for _, _, t in short], tok), strict=True):
                rows.append([row, doc, 1, 0, 0, *_closed(g, True), *_open(None)])
            if rows:
                yield _batch(rows)

        for batch in batches:
            held, size = [], 0
            for row, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not text:
                    yield _batch([[row, doc, 0, 0, 0, *_NOTHING, *_open(None)]])
                    continue
                held.append((row, doc, text))
                size += len(text)
                if size >= _BATCH:
                    yield from flush(held)
                    held, size = [], 0
            yield from flush(held)

    return run


def _joined(path_a: str, path_b: str, whole: bool):
    """Joins the fragments of one block; ``whole`` blocks are texts, so what stands at their start is a group too."""

    loaded: list[Tokenizers] = []  # by the first group of a task; empty on the driver

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if not loaded:
            loaded.append(Tokenizers.load(path_a, path_b))
        tok = loaded[0]
        rows = sorted(frame.itertuples(index=False), key=lambda r: r.chunk)
        doc, chunks = (None if pd.isna(v) else int(v) for v in (rows[0].doc_id, rows[0].chunks))
        total, closed = NEUTRAL, []
        for r in rows:
            a, b, c, d = (np.asarray(x, np.int64) for x in (r.prefix_a, r.prefix_b, r.suffix_a, r.suffix_b))
            cut = None if pd.isna(r.cut) else int(r.cut)
            total, group = joined(total, Fragment(cut, (a, b), (c, d)))
            if group is not None and len(group[0]):
                closed.append((cut, group))
        if whole and len(total.prefix[0]):
            closed.append((total.cut, total.prefix))
        groups = aligned([g for _, g in closed], tok)
        out = [[int(key[0]), doc, chunks, cut, 0, *_closed(g, False), *_open(None)] for (cut, _), g in zip(closed, groups, strict=True)]
        out.append([int(key[0]), doc, chunks, int(key[1]), -1, *_NOTHING, *_open(None if whole else total)])
        return pd.DataFrame(out, columns=_NAMES).astype({"doc_id": "Int64", "cut": "Int64"})

    return run


def alignment(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Closed groups of ``docs(doc_id, text)`` by row and place, written to the shared folder.

    One row for a text up to ``chunk`` bytes or without tokens; several, ordered by ``(chunk, place)``,
    for a longer one.  ``a``, ``b``, ``links`` are distinct pairs of linked ids and how often they link.
    """
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")
    )
    found = checkpoint(numbered.mapInArrow(_aligned_texts(path_a, path_b, chunk), _SCHEMA))
    ends = [x.split()[0] for x in _OPEN.split(", ")]
    parts = [found.drop(*ends)]
    left = found.agg(F.max("chunks")).first()[0] or 0
    # Round by round so many neighbours become one, until every text is one fragment.
    open_ends = found.where("chunks > 1").select("row", "doc_id", "chunks", "chunk", *ends)
    while left > 1:
        left = -(-left // fan)
        block = F.floor(F.col("chunk") / fan).cast("int")
        rounds = checkpoint(open_ends.groupBy("row", block.alias("block")).applyInPandas(_joined(path_a, path_b, left == 1), _SCHEMA))
        parts.append(rounds.where("place = 0").drop(*ends))
        open_ends = rounds.where("place = -1").select(open_ends.columns)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def judged(found: DataFrame) -> DataFrame:
    """Counts, digest and link quality per row of the aligned documents."""
    one, several = found.where("chunks <= 1"), found.where("chunks > 1")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("said") != "", F.struct("chunk", "place", "said")))), lambda x: x["said"]), ";")
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    heads = one.select("row", "doc_id", *counts, F.col("said").alias("groups_sha256")).unionByName(
        several.groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in counts], F.sha2(said, 256).alias("groups_sha256"))
    )

    def pairs(df: DataFrame) -> DataFrame:
        at = F.explode(F.arrays_zip("a", "b", "links")).alias("p")
        return df.select("row", at).select("row", "p.a", "p.b", F.col("p.links").cast("long").alias("links"))

    # A pair may stand in several fragments of one long text.
    held = pairs(one).unionByName(pairs(several).groupBy("row", "a", "b").agg(F.sum("links").alias("links")))
    known = checkpoint(held.groupBy("a", "b").agg(F.count("*").alias("n")))
    best = known.groupBy("a").agg(F.max("n").alias("top"))  # a row an id of the vocabulary at most
    rated = checkpoint(known.join(F.broadcast(best), "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best")))
    links = F.col("links")
    sums = (
        held.join(broadcast_if_small(rated, 32), ["a", "b"]).groupBy("row")
        .agg(F.sum(F.when(F.col("best"), links).otherwise(0)).alias("n_best"), F.sum(links * F.col("n")).alias("count_sum"))
    )
    zero = F.lit(0).cast("long")
    return heads.join(sums, "row", "left").select(
        "doc_id", *counts, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` per row of ``docs(doc_id, text)``.

    Texts that are null, empty, or not given back byte by byte by both tokenizers have no tokens: zeros
    and an empty digest.  Rows are documents of their own, whatever their ids; an empty table gives no
    rows; other columns are ignored.
    """
    return judged(alignment(docs, path_a, path_b, chunk, fan))
