"""Ranked lexical search: exact inner products of sparse integer vectors, found through ball trees.

A document is a vector of integer term values, a query one of integer term weights; their inner
product is the score.  Tasks gather documents into batches and build a ball tree over each: a node
knows the centroid of its documents and the radius around it, so ``q . c + |q| r`` bounds every
score below the node (Cauchy-Schwarz).  A query visits nodes best-first and stops where the bound
falls below its k-th score so far.  Bounds are computed in floating point and rounded up by more
than their error, so nothing is lost; leaves are scored in exact integers.

The bound depends on how axes are scaled, the product does not: document axes are stretched and
query axes shrunk so that the expected product of norm and radius is least.

Queries are cut into parts of bounded size.  A part's vocabulary and weights are what tasks hold
besides one batch of documents; each part is one scan, and a task sends ``k`` rows a query at most.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import per_batch, plain_words, utf8
from lodestone.operators.ranking import top_k
from lodestone.session import checkpoint

# Pairs of query and term in one part; a part holds more only if it is a single query.
PART_PAIRS = 1_000_000
# A tree holds so many documents and, unless a single document has more, so many values.
TREE_ROWS, TREE_VALUES = 8192, 2_000_000
LEAF_ROWS = 64
# A side of a split has at least one in so many rows, so a tree is never deep.
_LEAST_SHARE = 32


def query_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term)``, distinct, of ``items(item_id, text)``; terms as UTF-8 bytes.

    Rows that repeat an id are one query with the terms of all of them; rows without an id go.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, terms = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = set(plain_words(text))
            ids += [item] * len(found)
            terms += found
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], ["item_id", "term"])

    held = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), utf8("text").alias("text"))
    return per_batch(held, work, "item_id long, term binary").distinct()


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("item_id"), F.lit(parts))


def _parts(pairs: DataFrame, limit: int) -> int:
    """So many hash parts that none of them exceeds ``limit`` pairs, single queries aside."""
    sizes = checkpoint(pairs.groupBy("item_id").count())
    parts = 1
    while True:
        over = sizes.groupBy(_part(parts).alias("part")).agg(F.sum("count").alias("n"), F.count("*").alias("items"))
        if not over.where((F.col("n") > limit) & (F.col("items") > 1)).take(1):
            return parts
        parts *= 2


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, terms, tf)``: length and counts of the vocabulary's terms, per row with terms at all."""
    # Plain values: a broadcast is unpickled where this package need not be installed.
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = held.value
        lengths, terms, counts, kept = [], [], [], []
        for at, text in enumerate(batch.column(1).to_pylist()):
            words = plain_words(text)
            if words:
                counted = [(known[w], c) for w, c in Counter(words).items() if w in known]
                t, n = [x[0] for x in counted], [x[1] for x in counted]
                kept.append(at)
                lengths.append(len(words))
                terms.append(t)
                counts.append(n)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(kept, pa.int64())), pa.array(lengths, pa.int64()),
                pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64())),
            ],
            ["doc_id", "n", "terms", "tf"],
        )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    return per_batch(source, work, "doc_id long, n long, terms array<int>, tf array<long>")


@dataclass
class Queries:
    """The queries of one part: ids, the terms of each, integer weights of terms, and the scale of axes."""

    ids: np.ndarray
    terms: list[np.ndarray]
    weights: np.ndarray
    scale: np.ndarray


def term_weight(rows: int, df: int) -> int:
    """Rare terms weigh more; nothing negative."""
    return math.floor(1000 * math.log((2 * rows + 2) / (2 * df + 1)))


@dataclass
class Tree:
    """A ball tree over rows of a sparse matrix; leaves hold consecutive rows.

    ``below[i]`` are the two children of node ``i``, ``(-1, -1)`` for a leaf; ``span[i]`` its rows.
    Centroids are kept by term: those of term ``t`` are entries ``term_at[t] .. term_at[t + 1]``.
    """

    below: np.ndarray
    span: np.ndarray
    radius: np.ndarray
    node: np.ndarray
    value: np.ndarray
    term_at: np.ndarray


def _row_of(starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def _picked(starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the values of ``rows``, one row after the other."""
    sizes = starts[rows + 1] - starts[rows]
    ends = np.cumsum(sizes)
    return np.repeat(starts[rows] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def build_tree(starts: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, Tree]:
    """The order of rows and the tree over them; ``values`` are scaled and not negative.

    The rows of a node go to the nearer one of two far rows, which keeps groups of like rows whole;
    where that leaves one side with very little, they are split in half along the same line.
    """
    count = len(starts) - 1
    norms = np.bincount(_row_of(starts), values * values, minlength=count)
    order = np.arange(count)
    below: list[tuple[int, int]] = []
    span: list[tuple[int, int]] = []
    radius: list[float] = []
    nodes: list[np.ndarray] = []
    terms: list[np.ndarray] = []
    centres: list[np.ndarray] = []
    dense = np.zeros(width)

    def products(vector_columns, vector_values, rows_of, cols, vals, n):
        dense[vector_columns] = vector_values
        out = np.bincount(rows_of, vals * dense[cols], minlength=n)
        dense[vector_columns] = 0.0
        return out

    def one(row: int) -> tuple[np.ndarray, np.ndarray]:
        return columns[starts[row] : starts[row + 1]], values[starts[row] : starts[row + 1]]

    stack = [(0, count, -1, 0)]
    while stack:
        begin, end, parent, side = stack.pop()
        me = len(below)
        below.append((-1, -1))
        if parent >= 0:
            below[parent] = (me, below[parent][1]) if side == 0 else (below[parent][0], me)
        span.append((begin, end))
        rows = order[begin:end]
        n = end - begin
        place = _picked(starts, rows)
        cols, vals = columns[place], values[place]
        rows_of = np.repeat(np.arange(n), starts[rows + 1] - starts[rows])
        total = np.bincount(cols, vals, minlength=width) if len(cols) else np.zeros(width)
        used = np.flatnonzero(total)
        centre = total[used] / n
        # Computed square distances may be off by this; the radius covers it.
        square = float(centre @ centre)
        off = (len(used) + 64) * 2.0**-50
        to_centre = norms[rows] - 2 * products(used, centre, rows_of, cols, vals, n) + square
        radius.append(math.sqrt(max(0.0, float(np.max(to_centre + off * (norms[rows] + square), initial=0.0)))))
        nodes.append(np.full(len(used), me))
        terms.append(used)
        centres.append(centre)
        if n <= leaf:
            continue
        a = int(np.argmax(to_centre))
        to_a = norms[rows] - 2 * products(*one(rows[a]), rows_of, cols, vals, n)
        b = int(np.argmax(to_a))
        to_b = norms[rows] - 2 * products(*one(rows[b]), rows_of, cols, vals, n)
        nearer = (to_a + norms[rows[a]]) - (to_b + norms[rows[b]])
        cut = int((nearer < 0).sum())
        if min(cut, n - cut) * _LEAST_SHARE < n:
            cut = n // 2
        order[begin:end] = rows[np.argpartition(nearer, cut)]
        stack += [(begin, begin + cut, me, 0), (begin + cut, end, me, 1)]
    at = np.concatenate(terms) if terms else np.zeros(0, np.int64)
    by_term = np.argsort(at, kind="stable")
    term_at = np.zeros(width + 1, np.int64)
    np.cumsum(np.bincount(at, minlength=width), out=term_at[1:])
    return order, Tree(
        np.array(below).reshape(-1, 2), np.array(span).reshape(-1, 2), np.array(radius),
        np.concatenate(nodes)[by_term] if nodes else at, np.concatenate(centres)[by_term] if centres else np.zeros(0), term_at,
    )


def bounds(tree: Tree, terms: np.ndarray, query: np.ndarray) -> np.ndarray:
    """No score below a node exceeds its bound; ``query`` are the scaled weights of ``terms``."""
    sizes = tree.term_at[terms + 1] - tree.term_at[terms]
    place = _picked(tree.term_at, terms)
    near = np.bincount(tree.node[place], np.repeat(query, sizes) * tree.value[place], minlength=len(tree.radius))
    # All factors are positive, so the relative error stays below this share.
    return (near + math.sqrt(float(query @ query)) * tree.radius) * (1 + (len(terms) + 64) * 2.0**-50) + 0.5


class Search:
    """The best ``k`` documents of every query among the batches seen so far."""

    def __init__(self, queries: Queries, k: int) -> None:
        self.queries, self.k = queries, k
        # Per query a heap of (score, -doc_id); its least entry is the one to beat.
        self.best: list[list[tuple[int, int]]] = [[] for _ in queries.ids]
        self.scored = 0
        self.dense = np.zeros(len(queries.weights), np.int64)
        self.scaled = queries.weights / queries.scale

    def add(self, ids: np.ndarray, starts: np.ndarray, columns: np.ndarray, values: np.ndarray) -> None:
        """Search one batch of documents, given as integer rows."""
        scale = self.queries.scale
        order, tree = build_tree(starts, columns, values * scale[columns], len(scale))
        place = _picked(starts, order)
        columns, values, ids = columns[place], values[place], ids[order]
        sizes = (starts[1:] - starts[:-1])[order]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for q, terms in enumerate(self.queries.terms):
            heap = self.best[q]
            bound = bounds(tree, terms, self.scaled[terms])
            self.dense[terms] = self.queries.weights[terms]
            queue = [(-bound[0], 0)]
            while queue:
                negative, node = heapq.heappop(queue)
                # An equal score may still win by its id.
                if len(heap) == self.k and -negative < heap[0][0]:
                    break
                if tree.below[node][0] >= 0:
                    for child in tree.below[node]:
                        heapq.heappush(queue, (-bound[child], child))
                    continue
                begin, end = tree.span[node]
                a, b = starts[begin], starts[end]
                if a == b:
                    continue
                self.scored += int(end - begin)
                # Empty rows cannot be told apart by reduceat; running sums can.
                sums = np.concatenate([[0], np.cumsum(values[a:b] * self.dense[columns[a:b]])])
                scores = sums[starts[begin + 1 : end + 1] - a] - sums[starts[begin:end] - a]
                least = heap[0][0] if len(heap) == self.k else 1
                for i in np.flatnonzero(scores >= max(1, least)):
                    entry = (int(scores[i]), -int(ids[begin + i]))
                    if len(heap) < self.k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
            self.dense[terms] = 0

    def rows(self) -> pa.RecordBatch:
        flat = [(self.queries.ids[q], -d, s) for q, heap in enumerate(self.best) for s, d in heap]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)], ["item_id", "doc_id", "score"]
        )


def _found(vectors: DataFrame, queries: Queries, rows: int, length: int, k: int, k1: int, base: int, slope: int) -> DataFrame:
    """``(item_id, doc_id, score)``: ``k`` candidates a query and task at most."""
    held = vectors.sparkSession.sparkContext.broadcast((queries.ids, queries.terms, queries.weights, queries.scale))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(Queries(*held.value), k)
        for batch in batches:
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            offsets = batch.column(2).offsets.to_numpy().astype(np.int64)
            offsets -= offsets[0]
            columns, counts = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            m = base - slope + (slope * n * rows) // length
            values = (1_000_000_000 * counts) // (1000 * counts + k1 * np.repeat(m, np.diff(offsets)))
            begin = 0
            while begin < len(ids):
                end = int(np.searchsorted(offsets, offsets[begin] + TREE_VALUES, side="right")) - 1
                end = min(max(end, begin + 1), begin + TREE_ROWS, len(ids))
                a, b = offsets[begin], offsets[end]
                search.add(ids[begin:end], offsets[begin : end + 1] - a, columns[a:b], values[a:b])
                begin = end
        yield search.rows()

    return vectors.select("doc_id", "n", "terms", "tf").mapInArrow(run, "item_id long, doc_id long, score long")


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 50, part_pairs: int = PART_PAIRS, k1: int = 20, base: int = 100, slope: int = 50
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best rows of ``docs(doc_id, text)`` for each of ``items(item_id, text)``.

    Terms are runs of letters, digits and non-ASCII characters, only A-Z lower-cased.  Weights, lengths
    and values are the integers the contract states; scores are above 0, equal ones go by ``doc_id``.
    Null and blank texts have no terms and count nowhere.  Rows without a ``doc_id`` count in all
    statistics but are not returned; rows that repeat a ``doc_id`` are documents of their own.  Items that
    repeat an ``item_id`` are one query; items without id or terms, empty tables give no rows.  Other
    columns are ignored.
    """
    pairs = checkpoint(query_terms(items))
    parts = _parts(pairs, part_pairs)
    results = []
    for part in range(parts):
        mine = pairs.where(_part(parts) == part).orderBy("item_id", "term").toArrow()  # bounded by ``part_pairs``
        terms = sorted(set(mine.column("term").to_pylist()))
        vocabulary = {t: i for i, t in enumerate(terms)}
        vectors = checkpoint(_vectors(docs, vocabulary))
        rows, length = vectors.agg(F.count("*"), F.sum("n")).first()
        if not rows or not terms:
            continue
        df = np.zeros(len(terms), np.int64)
        seen = vectors.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()  # a row a term at most
        df[seen.column("t").to_numpy()] = seen.column("count").to_numpy()
        weights = np.array([term_weight(rows, int(d)) if d else 0 for d in df], np.int64)
        numbers = np.array([vocabulary[t] for t in mine.column("term").to_pylist()])
        ids, begins = np.unique(mine.column("item_id").to_numpy(), return_index=True)
        # Terms that no document holds, or that weigh nothing, add nothing.
        kept = [t[weights[t] > 0] for t in np.split(numbers, begins[1:])]
        asked = np.bincount(np.concatenate(kept), minlength=len(terms)) if kept else np.zeros(len(terms))
        scale = np.sqrt(np.maximum(weights, 1) * np.sqrt(np.maximum(asked, 1) / np.maximum(df, 1)))
        queries = Queries(ids, kept, weights, scale)
        useful = vectors.where("doc_id is not null and size(terms) > 0")
        results.append(_found(useful, queries, rows, length, k, k1, base, slope))
    if not results:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = results[0]
    for more in results[1:]:
        every = every.unionByName(more)
    best = top_k(every, ["item_id"], [F.desc("score"), F.asc("doc_id")], k, "rank")
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
