"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items of a shard go into one automaton over words.  Training texts stream
through it word by word; the state tells the longest run of words, ending here, that occurs in
some item.  Where it reaches the window length, or a whole shorter item, words are hit.

Items are sharded by their words, so an automaton is bounded whatever the size of the benchmark;
each shard is one scan of the documents, and intervals of several shards meet by document.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import per_batch, plain_words, utf8
from lodestone.session import checkpoint

# Words of the items of one shard, on average; about 1 kB of memory each once in the automaton.
SHARD_WORDS = 100_000


class Automaton:
    """A suffix automaton of several word sequences; state 0 is the empty run."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: list[set] = [set()]
        self.ends: list[list[tuple[int, int]]] = [[]]

    def _state(self, length: int, copied: int | None = None) -> int:
        self.next.append({} if copied is None else dict(self.next[copied]))
        self.link.append(-1 if copied is None else self.link[copied])
        self.length.append(length)
        self.items.append(set())
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state of the run of ``p`` followed by ``word``, split off its longer class ``q``."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        state = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        self.link[state] = 0 if p < 0 else self._split(p, word, self.next[p][word])
        return state

    def add(self, item: int, words: list[bytes]) -> None:
        """Add the words of an item; its number is put at the states of its windows by ``finish``."""
        last = 0
        for word in words:
            last = self._extend(last, word)

    def finish(self, items: list[tuple[int, list[bytes]]]) -> Automaton:
        """Mark the state of every window with the items that hold it."""
        for item, words in items:
            if 0 < len(words) < self.window:
                state = 0
                for word in words:
                    state = self.next[state][word]
                self.ends[state].append((len(words), item))
                continue
            state = length = 0
            for word in words:
                state = self.next[state][word]
                length += 1
                state, length = self._cut(state, length)
                if length == self.window:
                    self.items[state].add(item)
        # The nearest state on the way to the empty run that ends a short item.
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.short = [0] * len(self.link)
        for s in order[1:]:
            self.short[s] = s if self.ends[s] else self.short[self.link[s]]
        self.any_short = any(self.ends)
        return self

    def _cut(self, state: int, length: int) -> tuple[int, int]:
        """Shorten a run to the window; deeper states cannot tell more."""
        if length > self.window:
            length = self.window
            while self.length[self.link[state]] >= length:
                state = self.link[state]
        return state, length

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit intervals ``[start, end)``, merged, and the items with occurring windows."""
        state = length = 0
        following, link, lengths, window, items = self.next, self.link, self.length, self.window, self.items
        spans: list[tuple[int, int]] = []
        found: set = set()
        root = following[0]
        short = self.any_short
        for at, word in enumerate(words):
            if not length:
                # Most words: nothing is matched, and the word opens nothing.
                state = root.get(word, 0)
                if not state:
                    continue
                length = 1
            else:
                to = following[state].get(word)
                while to is None and state:
                    state = link[state]
                    length = lengths[state]
                    to = following[state].get(word)
                if to is None:
                    state = length = 0
                    continue
                state, length = to, length + 1
                if length > window:
                    length = window
                    while lengths[link[state]] >= length:
                        state = link[state]
            width = 0
            if length == window:
                found |= items[state]
                width = window
            if short:
                s = self.short[state]
                while s > 0:
                    for n, item in self.ends[s]:
                        if n <= length:
                            found.add(item)
                            width = max(width, n)
                    s = self.short[link[s]]
            if width:
                start = at + 1 - width
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, at + 1))
        return spans, found


def _shards(items: DataFrame, shard_words: int) -> tuple[DataFrame, int]:
    cut = per_batch(
        items.select(F.col("item_id").cast("long").alias("item_id"), utf8("text").alias("text")), _item_words,
        "item_id long, words array<binary>",
    ).where("size(words) > 0 and item_id is not null")
    held = checkpoint(cut)
    total = held.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_words))
    return held.withColumn("shard", F.pmod(F.xxhash64("item_id", "words"), F.lit(shards)).cast("int")), shards


def _item_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = [plain_words(t) for t in batch.column(1).to_pylist()]
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(words, pa.list_(pa.binary()))], ["item_id", "words"]
    )


def _automaton(shard: DataFrame, window: int) -> Automaton:
    """Built on the driver from one shard, which is bounded by the words a shard may hold."""
    rows = [(r[0], [bytes(w) for w in r[1]]) for r in shard.select("item_id", "words").toLocalIterator()]
    built = Automaton(window)
    for item, words in rows:
        built.add(item, words)
    return built.finish(rows)


def matches(
    docs: DataFrame, items: DataFrame, window: int = 13, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """``(doc_id, n_words, spans, items)`` per row of ``docs(doc_id, text)``.

    ``spans`` are the merged intervals of words (``start``, ``end`` exclusive) inside occurrences of
    windows of ``items(item_id, text)``; ``items`` the sorted ids of items with occurring windows.
    An item of fewer words than the window is one window.  Null or blank texts have no words;
    items without words or id match nothing.  Other columns are ignored.
    """
    sharded, shards = _shards(items, shard_words)
    spark = docs.sparkSession
    # Rows are told apart by a number while several shards meet.
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    if shards > 1:
        source = checkpoint(source.withColumn("row", F.monotonically_increasing_id()))
    else:
        source = source.withColumn("row", F.lit(0).cast("long"))
    scans = []
    for shard in range(shards):
        held = spark.sparkContext.broadcast(_automaton(sharded.where(F.col("shard") == shard), window))

        def work(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            automaton = held.value
            for batch in batches:
                out = []
                for text in batch.column("text").to_pylist():
                    words = plain_words(text)
                    spans, found = automaton.scan(words)
                    out.append((len(words), [{"start": a, "end": b} for a, b in spans], sorted(found)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"), batch.column("doc_id"), pa.array([o[0] for o in out], pa.int64()),
                        pa.array([o[1] for o in out], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array([o[2] for o in out], pa.list_(pa.int64())),
                    ],
                    ["row", "doc_id", "n_words", "spans", "items"],
                )

        scans.append(source.mapInArrow(
            work, "row long, doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<long>"
        ))
    if shards == 1:
        return scans[0].drop("row")
    every = scans[0]
    for scan in scans[1:]:
        every = every.unionByName(scan)
    met = every.groupBy("row", "doc_id", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return met.select("doc_id", "n_words", _merged("spans").alias("spans"), "items")


def _merged(column: str):
    """Sorted intervals with overlapping and touching ones joined."""
    kind = "array<struct<start:int,end:int>>"
    return F.aggregate(
        F.col(column), F.array().cast(kind),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(
                    F.element_at(done, -1)["start"].alias("start"),
                    F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"),
                )),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )


def judged(found: DataFrame, parts: int = 20) -> DataFrame:
    """Counts and the verdict: contaminated if at least one in ``parts`` of the words is hit."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    counted = found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), "spans",
    )
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * parts >= F.col("n_words")))


# The same characters as ``plain_words``, on text.
_RAW_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def cleaned(
    docs: DataFrame, items: DataFrame, window: int = 13, parts: int = 20, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """``docs`` with all its columns: spans of windows cut out of contaminated texts.

    A text that falls under ``parts`` (one in twenty) is left as it is.  A contaminated text of
    which half or more is hit is dropped, as what would remain is a torn test item; of the others
    the text from the first to the last hit word of each span goes.  ``n_chars``, if there is such
    a column, is counted anew.
    """
    numbered = checkpoint(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = matches(numbered.select(F.col("__row").alias("doc_id"), "text"), items, window, shard_words)
    verdict = checkpoint(judged(found, parts).where("contaminated").select(
        F.col("doc_id").alias("__hit_row"), F.col("spans").alias("__spans"),
        (F.col("n_hit") * 2 >= F.col("n_words")).alias("__whole"),
    ))
    joined = numbered.join(verdict, F.col("__row") == F.col("__hit_row"), "left").where(
        "not coalesce(__whole, false)"
    )

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        out = []
        for text, hit in zip(texts, spans, strict=True):
            places = [m.span() for m in _RAW_WORD.finditer(text)]
            at, kept = 0, []
            for s in hit:
                kept.append(text[at : places[s["start"]][0]])
                at = places[s["end"] - 1][1]
            out.append("".join([*kept, text[at:]]))
        return pd.Series(out)

    touched = joined.where("__spans is not null").withColumn("text", cut("text", "__spans"))
    if "n_chars" in docs.columns:
        touched = touched.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.where("__spans is null").select(docs.columns).unionByName(touched.select(docs.columns))
