"""Near-duplicates by bottom-k sketches.

One hash function serves all: the ``sketch`` smallest hashes of a document's shingles are its
sketch.  Inverted lists of retained values give overlapping documents, the sketch of the union
estimates their similarity, and the full shingle sets decide.

Documents of equal shingle sets collapse into one class first, so only classes are compared.

* **Lists.** Of the ``listed`` smallest values two similar classes share ``_SHARED`` at least (the
  mean is 0.8 of them, the bound six deviations below).  So they also share one of the
  ``listed - shared + 1`` values that are rarest in the corpus, and only these are listed.
  Values of passages many documents share are thereby listed for near copies only.
* **Leaders.** The smallest class of every list meets all others of it: a linear number of pairs.
* **The rest, exactly.** Members of one component need not be linked again.  In lists that still
  hold several components, each class outside of the largest meets every class of another
  component.  It offers its likeliest partners first; a confirmed one settles the others of that
  component, and the last round offers all that are still apart.  There is no cap: what is saved
  is what connectivity already settles.
* A pair is compared in the list of its first common value only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import (
    WordHashes, arrays, gram_hashes, groups, lists, maybe_in, per_batch, space_words, utf8,
)
from lodestone.llm.components import connected
from lodestone.session import checkpoint

# Standard deviations an estimate may lie below the threshold before a pair is given up.
_Z = 5.0
# Classes of a list that meet in one task at most, on either side.  A list of more is copied to a grid
# of blocks, each class once per block of the other side, which for all pairs in bounded memory is the least.
_BLOCK = 4096
# Rows and columns of the overlap matrix at hand.
_ROWS = 256
_COLUMNS = 1024
# Partners a class offers per list and block in successive rounds; the last leaves none out.
_ALL = 1 << 62
_OFFERS = (1, 8, _ALL)


def _sets(words: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``k`` make one shingle, none make none."""
    if not words:
        return np.zeros(0, dtype=np.int64)
    return np.unique(gram_hashes(hashes.of(words), min(k, len(words))))


def _key(hashed: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(hashed.tobytes()) if len(hashed) else None


def signatures(docs: DataFrame, shingle: int, sketch: int) -> DataFrame:
    """``(doc_id, n_shingles, key, sketch)``; the key names the set of shingles and is null without any."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = WordHashes()
        sets = [_sets(space_words(t), shingle, hashes) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_key(s) for s in sets], pa.binary()),
                lists([s[:sketch] for s in sets], pa.int64()),
            ],
            ["doc_id", "n_shingles", "key", "sketch"],
        )

    return per_batch(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")), work,
        "doc_id long, n_shingles long, key binary, sketch array<long>",
    )


def _full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = WordHashes()
        sets = [_sets(space_words(t), shingle, hashes) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [pa.array([_key(s) for s in sets], pa.binary()), lists(sets, pa.int64())], ["key", "hashes"]
        )

    return per_batch(docs.select(utf8("text").alias("text")), work, "key binary, hashes array<long>")


def _shared(listed: int, similarity: float) -> int:
    """Values of the ``listed`` smallest that two similar sets share all but surely."""
    mean = similarity * listed
    return max(1, math.floor(mean - 6 * math.sqrt(mean * (1 - similarity))))


def _listings(classes: DataFrame, listed: int, shared: int) -> DataFrame:
    """``(key, prefix)``: the listed values of every class that shares enough of them with others."""
    values = classes.select("key", F.slice("sketch", 1, listed).alias("low")).select(
        "key", F.size("low").alias("s"), F.explode("low").alias("value")
    )
    common = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    found = values.join(common, "value").groupBy("key", "s").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("found")
    )
    # Values no other class has come first in the order of rarity and lead nowhere.  A short
    # sketch is the whole set, of which similar sets share the same part or more.
    least = F.ceil(F.col("s") * F.lit(shared / listed)).cast("int")
    take = F.size("found") - least + 1
    return (
        found.withColumn("take", take).where("take > 0")
        .select("key", F.transform(F.slice("found", 1, F.col("take")), lambda x: x["value"]).alias("prefix"))
    )


def _estimate_passes(a: str, b: str, sketch: int, num: int, den: int) -> Column:
    """Whether the sketch of the union leaves room for the threshold."""
    sa, sb = F.col(f"{a}sketch"), F.col(f"{b}sketch")
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    union = F.slice(F.array_sort(F.array_union(sa, sb)), 1, sketch)
    both = F.size(F.array_intersect(union, F.array_intersect(sa, sb)))
    j = num / den
    whole = (na + nb) / F.lit(1 + j)
    k = F.size(union)
    spread = F.sqrt(F.lit(j * (1 - j)) / k * F.greatest(F.lit(0.0), 1 - k / whole))
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (both >= (F.lit(j - 1e-9) - _Z * spread) * k)


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .where(both * den >= num * (F.size("ha") + F.size("hb") - both)).select("a", "b")
    )


def near_duplicates(
    docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, sketch: int = 128, listed: int = 32
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs(doc_id, text)``.

    Documents link if ``den * intersection >= num * union`` of their sets of distinct word
    shingles.  ``component_id`` is the smallest id a document reaches over links, ``kept`` marks
    the document of that id.  Texts that are null, empty or blank have no shingles and link with
    nothing.  Rows that repeat an id and a text are alike in all columns.  A null id is
    represented by the smallest id of its component (null if alone, then ``kept`` is true).
    Other columns are ignored; an empty table gives an empty one.
    """
    signed = checkpoint(signatures(docs, shingle, sketch))
    classes = signed.where("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")
    )
    shared = _shared(listed, num / den)
    listing = checkpoint(_listings(classes, listed, shared))
    # The classes that stand in any list; from here on a number names a class.
    known = checkpoint(
        classes.join(listing, "key").withColumn("node", F.monotonically_increasing_id())
        .select("node", "key", "rep", "n", "sketch", "prefix")
    )
    sources = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if known.isEmpty():
        links = None
    else:
        some = maybe_in(sources, F.col("doc_id"), known.where("rep is not null"), F.col("rep"))
        nameless = sources.where("doc_id is null")
        sets = checkpoint(
            _full_sets(some.unionByName(nameless), shingle).join(known.select("key", "node"), "key")
            .select("node", "hashes").dropDuplicates(["node"])
        )
        links = _links(known, sets, sketch, num, den)
    members = signed.select("doc_id", "n_shingles", "key")
    if links is None:
        rooted = members.withColumn("root", F.col("key"))
    else:
        names = known.select("node", "key")
        roots = connected(links).join(names, "node").join(
            names.select(F.col("node").alias("root"), F.col("key").alias("root_key")), "root"
        ).select("key", "root_key")
        rooted = members.join(roots, "key", "left").withColumn("root", F.coalesce("root_key", "key"))
    least = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rooted.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("least", "doc_id")).alias("kept"),
    )


def _links(known: DataFrame, sets: DataFrame, sketch: int, num: int, den: int) -> DataFrame:
    entries = checkpoint(known.select("node", F.explode("prefix").alias("value")))
    sized = entries.groupBy("value").agg(F.min("node").alias("a"), F.count("*").alias("size")).where("size > 1")
    leaders = entries.join(sized, "value").where("node != a").select("a", F.col("node").alias("b")).distinct()
    left = known.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("asketch"))
    right = known.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("sketch").alias("bsketch"))
    passing = leaders.join(left, "a").join(right, "b").where(_estimate_passes("a", "b", sketch, num, den))
    first = checkpoint(_confirmed(passing.select("a", "b"), sets, num, den))

    # Lists of three or more that still hold several components.
    crowded = checkpoint(entries.join(sized.where("size > 2"), "value"))
    links, tried = first, None
    for turn, width in enumerate(_OFFERS):
        placed = crowded.join(connected(links), "node", "left").select(
            "value", "node", F.col("a").alias("leader"), F.coalesce("root", "node").alias("root"), "size"
        )
        counts = placed.groupBy("value", "root").agg(F.count("*").alias("c"))
        open_lists = counts.groupBy("value").agg(
            F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("roots")
        ).where("roots > 1").select("value", F.col("most.root").alias("top"), F.col("most.c").alias("settled_size"))
        offers = checkpoint(
            _rest(placed.join(open_lists, "value"), known, sketch, num, den, width, inside=turn == 0)
        )
        fresh = offers if tried is None else offers.join(tried, ["a", "b"], "left_anti")
        if turn + 1 < len(_OFFERS):
            fresh = fresh.groupBy("a").agg(F.max(F.struct("estimate", "b")).getField("b").alias("b"))
        fresh = checkpoint(fresh.select("a", "b"))
        links = checkpoint(links.unionByName(_confirmed(fresh, sets, num, den)))
        tried = fresh if tried is None else tried.unionByName(fresh)
        # A list without offers has no candidates left.  In the first turn the blocks of a list
        # have not met each other yet, so lists of several blocks stay.
        offering = offers.select("value").distinct().withColumn("offers", F.lit(True))
        kept = F.col("offers").isNotNull()
        if turn == 0:
            kept = kept | (F.col("size") > _BLOCK)
        crowded = checkpoint(crowded.join(offering, "value", "left").where(kept).drop("offers"))
        if crowded.isEmpty():
            break
    return links


def _meetings(rows: DataFrame, inside: bool) -> DataFrame:
    """Rows of lists with their block ``own`` and, once for each, the blocks ``other`` they meet.

    With ``inside`` a block meets only itself.  Otherwise the settled part of a list, the largest
    component, has blocks of its own, which meet those of the other classes but not one another.
    """
    def block(size: Column) -> Column:
        return F.pmod(F.xxhash64("node", "value"), F.greatest(F.lit(1), F.ceil(size / _BLOCK))).cast("int")

    if inside:
        return rows.withColumn("own", block(F.col("size"))).withColumn("other", F.col("own"))
    # A list of one block meets itself and needs no copies.
    one = rows.where(F.col("size") <= _BLOCK).withColumn("own", F.lit(0)).withColumn("other", F.lit(0))
    rows = rows.where(F.col("size") > _BLOCK)
    settled = F.col("settled_size")
    apart = F.col("size") - settled
    ours = F.ceil(apart / _BLOCK).cast("int")
    last = ours + F.when(F.col("settled"), F.lit(0)).otherwise(F.ceil(settled / _BLOCK).cast("int")) - 1
    own = F.when(F.col("settled"), ours + block(settled)).otherwise(block(apart))
    return rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last))).unionByName(one)


def _rest(
    placed: DataFrame, known: DataFrame, sketch: int, num: int, den: int, width: int, inside: bool
) -> DataFrame:
    """``(value, a, b, estimate)``: of every ``a`` its ``width`` likeliest partners per open list and block."""
    rows = _meetings(
        placed.withColumn("settled", F.col("root") == F.col("top"))
        .join(known.select("node", "n", "sketch", "prefix"), "node"), inside
    ).select(
        "value", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
        "own", "node", "root", "n", "settled", (F.col("node") == F.col("leader")).alias("leads"), "sketch", "prefix",
    )

    def work(batches):
        for group in groups(batches, 3):
            yield from _compare(group, sketch, num / den, width)

    spread = rows.repartition("value", "x", "y").sortWithinPartitions("value", "x", "y")
    return spread.mapInArrow(work, "value long, a long, b long, estimate double")


def _overlaps(sketches: list[np.ndarray], rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``_ROWS`` of the ``rows`` at a time: common values of their sketches with all sketches."""
    values, codes, counts = np.unique(np.concatenate(sketches), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sketches)), [len(s) for s in sketches])
    shared = np.cumsum(counts > 1) - 1
    keep = counts[codes] > 1
    owner, codes = owner[keep], shared[codes[keep]]
    order = np.argsort(codes, kind="stable")
    owner, codes = owner[order], codes[order]
    last = int(shared[-1]) + 1 if len(shared) else 0
    for first in range(0, len(rows), _ROWS):
        some = rows[first : first + _ROWS]
        total = np.zeros((len(some), len(sketches)), dtype=np.float32)
        for begin in range(0, last, _COLUMNS):
            lo, hi = np.searchsorted(codes, (begin, begin + _COLUMNS))
            held = np.zeros((len(sketches), min(_COLUMNS, last - begin)), dtype=np.float32)
            held[owner[lo:hi], codes[lo:hi] - begin] = 1.0
            total += held[some] @ held.T
        yield some, total


def _compare(group: pa.Table, sketch: int, j: float, width: int) -> Iterator[pa.RecordBatch]:
    value, x, y = (group.column(i)[0].as_py() for i in range(3))
    own, node, root, n = (group.column(i).to_numpy() for i in range(3, 7))
    settled, leads = (group.column(i).to_numpy() for i in (7, 8))
    rows = np.flatnonzero(~settled & ~leads)
    if not len(rows):
        return
    sketches = arrays(group.column("sketch"))
    prefixes = [set(p.tolist()) for p in arrays(group.column("prefix"))]
    # Both sketches are complete up to the smaller of their last values.
    last = np.array([s[-1] if len(s) == sketch else np.iinfo(np.int64).max for s in sketches])
    for some, common in _overlaps(sketches, rows):
        reach = np.array([np.searchsorted(sketches[i], last, side="right") for i in some])
        back = np.array([np.searchsorted(s, last[some], side="right") for s in sketches]).T
        union = reach + back - common
        whole = (n[some][:, None] + n[None, :]) / (1 + j)
        spread = np.sqrt(j * (1 - j) / union * np.maximum(0.0, 1 - union / whole))
        sizes = np.minimum(n[some][:, None], n[None, :]) >= (j - 1e-9) * np.maximum(n[some][:, None], n[None, :])
        good = sizes & (common >= (j - 1e-9 - _Z * spread) * union) & (root[some][:, None] != root[None, :])
        good &= ~leads[None, :] & (settled[None, :] | (node[some][:, None] < node[None, :]))
        if x != y:
            good &= own[some][:, None] != own[None, :]
        left, right = np.nonzero(good)
        first = [min(prefixes[some[a]] & prefixes[b]) == value for a, b in zip(left, right, strict=True)]
        left, right = left[first], right[first]
        if not len(left):
            continue
        estimate = (common[left, right] / union[left, right]).astype(np.float64)
        order = np.lexsort((node[right], -estimate, left))
        left, right, estimate = left[order], right[order], estimate[order]
        best = np.arange(len(left)) - np.searchsorted(left, left) < width
        left, right, estimate = left[best], right[best], estimate[best]
        yield pa.RecordBatch.from_arrays(
            [pa.array([value] * len(left), pa.int64()), pa.array(node[some[left]]), pa.array(node[right]), pa.array(estimate)],
            ["value", "a", "b", "estimate"],
        )
