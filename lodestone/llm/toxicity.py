"""Toxicity: a learned lexicon, matched exactly and through Levenshtein automata, read in context.

* **Lexicon.** Words and word beginnings (stems of inflected forms) whose documents are labelled
  toxic far more often than others, over a bounded sample of labelled rows.  A term must occur in
  several different contexts, so the plain words of one copied toxic text do not count.
* **Misspellings.** The automaton of a text's word, accepting all strings within one edit (two for
  long words), runs down the trie of all words and stems of five letters or more; both fail early
  together.  A stem is accepted with any rest.  Terms whose misspellings are mostly other words of
  clean texts keep a share of their weight, by the sample.
* **Context.** A hit counts less inside quotation marks and more beside other hits.
* **Score.** A logistic model over a text's hits, fitted on the same sample.

Texts are scored by one column expression, so scoring needs no shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import plain_words, utf8
from lodestone.llm.decontam import _RAW_WORD
from lodestone.session import checkpoint

# Labelled rows a model is fitted on, in expectation; drawn by a hash of the id.
TRAINING_ROWS = 20_000
# Terms of the lexicon at most: the strongest.
LEXICON_TERMS = 2_000
_STEM = range(4, 9)
_FLUSH = 300_000
# Answers a worker remembers.
_REMEMBERED = 100_000
_CONTEXT = 8
_OPENING, _CLOSING = "\"“„«‹‘", "\"”“»›’"


class LevenshteinAutomaton:
    """Accepts what lies within ``edits`` of a word; a state is a tuple of (position, edits so far)."""

    def __init__(self, word: str, edits: int) -> None:
        self.word, self.edits = word, edits

    def start(self) -> tuple[tuple[int, int], ...]:
        return tuple((i, i) for i in range(min(self.edits, len(self.word)) + 1))

    def step(self, state: tuple[tuple[int, int], ...], letter: str) -> tuple[tuple[int, int], ...]:
        best: dict[int, int] = {}

        def reach(position: int, edits: int) -> None:
            while edits <= self.edits and edits < best.get(position, self.edits + 1):
                best[position] = edits
                # A letter of the word may be missing.
                position, edits = position + 1, edits + 1
                if position > len(self.word):
                    return

        for position, edits in state:
            reach(position, edits + 1)
            if position < len(self.word):
                reach(position + 1, edits + (self.word[position] != letter))
        return tuple(best.items())

    def distance(self, state: tuple[tuple[int, int], ...]) -> int | None:
        """Edits at the end of the word, or None if the state does not accept."""
        ends = [e + len(self.word) - p for p, e in state if e + len(self.word) - p <= self.edits]
        return min(ends, default=None)


@dataclass
class Lexicon:
    """Terms with weights; stems match what begins with them."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    # What a misspelling keeps of the weight of its term; all of it where nothing is known.
    shares: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.trie: dict = {}
        # By length of a text's word: where a piece of a word may stand in it.  Of stems, at any length.
        self.pieces: dict[int, dict[tuple[int, int], set[str]]] = {}
        self.stem_pieces: dict[tuple[int, int], set[str]] = {}
        self.stem_lengths = sorted({len(s) for s in self.stems})
        for term, stem in [*((w, False) for w in self.words), *((s, True) for s in self.stems)]:
            edits = allowed_edits(term)
            if not edits or self.shares.get(term) == 0.0:
                continue
            node = self.trie
            for letter in term:
                node = node.setdefault(letter, {})
            # Keys of no letter end a word and a stem.
            node["stem" if stem else ""] = term
            # Of edits + 1 pieces of a term one survives any ``edits`` edits, moved by as many places at most.
            cut = [round(i * len(term) / (edits + 1)) for i in range(edits + 2)]
            tables = [self.stem_pieces] if stem else [
                self.pieces.setdefault(n, {}) for n in range(len(term) - edits, len(term) + edits + 1)
            ]
            for a, b in zip(cut, cut[1:], strict=False):
                for table in tables:
                    for at in range(max(0, a - edits), a + edits + 1):
                        table.setdefault((at, at + b - a), set()).add(term[a:b])

    def match(self, word: str) -> tuple[float, bool] | None:
        """Weight of the term a word stands for, and whether it is misspelled."""
        if word in self.words:
            return self.words[word], False
        for length in self.stem_lengths:
            if word[:length] in self.stems:
                return self.stems[word[:length]], False
        term = self.nearest(word)
        weight = self.weight(term) * self.shares.get(term, 1.0) if term else 0.0
        return (weight, True) if weight > 0 else None

    def weight(self, term: str) -> float:
        return self.words[term] if term in self.words else self.stems[term]

    def nearest(self, word: str) -> str | None:
        """The term nearest to ``word`` within the edits its length allows; a stem, to a beginning of ``word``."""
        tables = (self.pieces.get(len(word), {}), self.stem_pieces)
        if not any(word[a:b] in known for places in tables for (a, b), known in places.items()):
            return None
        automaton = LevenshteinAutomaton(word, 2)
        found: list[tuple[int, float, str]] = []
        stack = [(self.trie, automaton.start())]
        while stack:
            node, state = stack.pop()
            for letter, below in node.items():
                if len(letter) != 1:
                    # After a stem any rest may follow.
                    distance = min(e for _, e in state) if letter else automaton.distance(state)
                    if distance is not None and distance <= allowed_edits(below):
                        found.append((distance, -self.weight(below), below))
                    continue
                following = automaton.step(state, letter)
                if following:
                    stack.append((below, following))
        return min(found)[2] if found else None


def allowed_edits(term: str) -> int:
    """Short words have too many real neighbours to be guessed."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


def _words(text: str | None) -> list[bytes]:
    return plain_words(text.lower().encode()) if text else []


def _terms(words: list[bytes]) -> set[tuple[bool, str]]:
    """Words and beginnings of words of one text; ``True`` marks a beginning."""
    out: set[tuple[bool, str]] = set()
    for raw in set(words):
        word = raw.decode("utf-8", "replace")
        out.add((False, word))
        out.update((True, word[:n]) for n in _STEM if len(word) > n)
    return out


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: list[Counter] = [Counter(), Counter()]

    def flush() -> pa.RecordBatch:
        keys = list(counts[0].keys() | counts[1].keys())
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.bool_()), pa.array([k[1] for k in keys], pa.string()),
                pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64()),
            ],
            ["stem", "term", "toxic", "clean"],
        )
        counts[0].clear()
        counts[1].clear()
        return batch

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[toxic].update(_terms(_words(text)))
            if len(counts[0]) + len(counts[1]) > _FLUSH:
                yield flush()
    yield flush()


def learn_lexicon(sample: DataFrame, least: int = 4, log_odds: float = 3.0, terms: int = LEXICON_TERMS) -> Lexicon:
    """The lexicon of ``sample(text, toxic)``: terms in ``least`` toxic contexts and beyond ``log_odds``."""
    totals = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic:
        return Lexicon()
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    strong = (
        sample.select("text", "toxic").mapInArrow(_counted, "stem boolean, term string, toxic long, clean long")
        .groupBy("stem", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= least).withColumn("weight", weight).where(F.col("weight") >= log_odds)
        # A bound on what reaches the driver; many inflected forms stand behind one stem.
        .orderBy(F.desc("toxic"), F.desc("weight"), "term", "stem").limit(10 * terms).collect()
    )
    # The best terms show what this sample can tell apart; far below them stand chance finds.
    bar = 0.55 * max((r["weight"] for r in strong), default=0.0)
    candidates = {(r["stem"], r["term"]): r["weight"] for r in strong if r["weight"] >= bar}

    def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for text in batch.column(0).to_pylist():
                words = [w.decode("utf-8", "replace") for w in _words(text)]
                for i, word in enumerate(words):
                    near = f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}"
                    for key in [(False, word), *[(True, word[:n]) for n in _STEM if len(word) > n]]:
                        if key in candidates:
                            rows.add((*key, near))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.bool_(), pa.string(), pa.string()))],
                ["stem", "term", "near"],
            )

    seen = (
        sample.where("toxic = 1").select("text").mapInArrow(contexts, "stem boolean, term string, near string")
        .distinct().groupBy("stem", "term").count().where(F.col("count") >= least).collect()
    )
    varied = {(r["stem"], r["term"]): r["count"] for r in seen}
    chosen = Lexicon()
    # The shortest pure stem stands for its longer ones and their words, unless a word carries it alone.
    for stem, term in sorted(varied, key=lambda k: (len(k[1]), k[1], k[0])):
        if any(term[:n] in chosen.stems for n in range(1, len(term) + 1)):
            continue
        if stem:
            alone = max((c for (s, t), c in varied.items() if not s and t.startswith(term)), default=0)
            if alone >= 0.6 * varied[(stem, term)]:
                continue
            chosen.stems[term] = candidates[(stem, term)]
        else:
            chosen.words[term] = candidates[(stem, term)]
    strongest = sorted([*chosen.words.items(), *chosen.stems.items()], key=lambda x: (-x[1], x[0]))[:terms]
    kept = {t for t, _ in strongest}
    return Lexicon(
        {t: w for t, w in chosen.words.items() if t in kept}, {t: w for t, w in chosen.stems.items() if t in kept}
    )


def with_shares(lexicon: Lexicon, sample: DataFrame) -> Lexicon:
    """``lexicon`` with shares by how much more often texts without exact hits that misspell a term are toxic."""
    totals = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = _Matches(lexicon)
        nearest: dict[bytes, str | None] = {}
        counts: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hits = {w: m[1] for w in set(_words(text)) if (m := matches[w])}
                if not all(hits.values()):
                    continue
                for w in hits.keys() - nearest.keys():
                    nearest[w] = lexicon.nearest(w.decode("utf-8", "replace"))
                counts.update((term, toxic) for term in {nearest[w] for w in hits})
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())],
            ["term", "toxic", "n"],
        )

    seen = sample.select("text", "toxic").mapInArrow(work, "term string, toxic long, n long").groupBy("term", "toxic").agg(F.sum("n").alias("n"))
    found = {(r["term"], r["toxic"]): r["n"] for r in seen.collect()}  # two rows a term at most
    shares = {}
    for term in [*lexicon.words, *lexicon.stems]:
        bad, good = ((found.get((term, y), 0) + 0.5) / (totals.get(y, 0) + 1.0) for y in (1, 0))
        if (term, 0) in found or (term, 1) in found:
            shares[term] = max(0.0, (bad - good) / (bad + good))
    return Lexicon(lexicon.words, lexicon.stems, shares)


class _Matches(dict):
    """Answers of a lexicon, remembered up to a bound."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> tuple[float, bool] | None:
        if len(self) > _REMEMBERED:
            self.clear()
        value = self[word] = self.lexicon.match(word.decode("utf-8", "replace"))
        return value


FEATURES = 4


def features(text: str | None, matches: _Matches) -> list[float]:
    """Strongest hit in context, strongest misspelled hit, log of the sum of hits, all hits quoted."""
    words = _words(text)
    hits = [(i, m) for i, m in enumerate(map(matches.__getitem__, words)) if m]
    if not hits:
        return [0.0] * FEATURES
    places = [m.span() for m in _RAW_WORD.finditer(text)]
    quoted = [_quoted(text, places[i]) if i < len(places) else False for i, _ in hits]
    exact = fuzzy = total = 0.0
    first = past = 0
    for (i, (weight, misspelled)), inside in zip(hits, quoted, strict=True):
        # Hits ``first .. past`` stand in context, this one among them.
        while hits[first][0] < i - _CONTEXT:
            first += 1
        while past < len(hits) and hits[past][0] <= i + _CONTEXT:
            past += 1
        near = past - first - 1
        score = weight / 10 * (0.5 if inside else 1.0) * (1 + 0.1 * min(near, 5))
        total += score
        if misspelled:
            fuzzy = max(fuzzy, score)
        else:
            exact = max(exact, score)
    return [exact, fuzzy, math.log1p(total), float(all(quoted))]


def _quoted(text: str, place: tuple[int, int]) -> bool:
    """Whether a quotation mark opens shortly before and closes shortly after."""
    before, after = text[max(0, place[0] - 80) : place[0]], text[place[1] : place[1] + 80]
    opening = max((before.rfind(c) for c in _OPENING), default=-1)
    if opening < 0 or "\n" in before[opening:] or before.count('"') % 2 == 0 and before[opening] == '"':
        return False
    return any(c in after.split("\n")[0] for c in _CLOSING)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def column(self, text: str | Column) -> Column:
        """The score of a text column; a null or empty text gets the score of a text without hits."""
        model = self

        @F.pandas_udf("double")
        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matches = _Matches(model.lexicon)
            for texts in parts:
                x = np.array([features(t, matches) for t in texts], dtype=np.float64).reshape(-1, FEATURES)
                yield pd.Series(1 / (1 + np.exp(-(x @ model.weights + model.bias))))

        return score(text)


# Where the sample says nothing: a hit is evidence, a quoted one less.
_PRIOR = np.array([4.0, 3.0, 1.0, -1.5])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps with a Gaussian prior around ``_PRIOR``."""
    design = np.hstack([x, np.ones((len(x), 1))])
    prior = np.append(_PRIOR, -3.0)
    stiff = np.diag([ridge] * FEATURES + [0.1])
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (p - y) + stiff @ (w - prior)
        curve = design.T @ (design * (p * (1 - p))[:, None]) + stiff
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def held_out(doc_id: str | Column) -> Column:
    """Rows never learned from; false for a null id, which is not learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    Only rows that are not held out, with a label 0 or 1 and a text, are used; of conflicting
    labels of one id the larger counts, of equal texts one.  Without usable rows the lexicon is
    empty and all texts get the same low score.
    """
    usable = (
        labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out("doc_id"))
        .groupBy(F.col("doc_id").alias("__labelled")).agg(F.max("toxic").cast("int").alias("__toxic"))
    )
    count = usable.count()
    share = min(1.0, rows / max(1, count))
    drawn = usable.where(F.pmod(F.xxhash64("__labelled"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = checkpoint(
        docs.select("doc_id", "text").where("text is not null")
        .join(drawn, F.col("doc_id") == F.col("__labelled")).groupBy("text").agg(F.max("__toxic").alias("toxic"))
    )
    lexicon = with_shares(learn_lexicon(sample), sample)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = _Matches(lexicon)
        counts: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[(*features(text, matches), toxic)] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([[float(v) for v in k] for k in counts], pa.list_(pa.float64())), pa.array(list(counts.values()), pa.int64())],
            ["x", "n"],
        )

    seen = sample.select("text", "toxic").mapInArrow(work, "x array<double>, n long").groupBy("x").agg(F.sum("n").alias("n"))
    table = [(r["x"], r["n"]) for r in seen.collect()]  # bounded by the sample
    if not table:
        return Model(lexicon, _PRIOR, -3.0)
    x = np.repeat(np.array([t[0] for t in table]), [t[1] for t in table], axis=0)
    weights, bias = fit(x[:, :-1], x[:, -1])
    return Model(lexicon, weights, bias)


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row; other columns are ignored, nulls are defined above."""
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), model.column("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold."""
    return docs.where(model.column("text") < threshold)
