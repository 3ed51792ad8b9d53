"""License scans: an Aho-Corasick automaton for tags and notices, a shunting-yard parser for expressions.

The automaton runs over the normalised words of a text joined by blanks, so a pattern is found
wherever its words stand consecutively.  Where it finds an identifier tag, the expression after the
tag is read from the text itself, parsed to postfix order and evaluated to licence labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import plain_words

# Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices beyond the base, and how sure they make a licence.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "bsd license": ("bsd", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "creative commons attribution": ("cc-by", 0.8),
    "public domain": ("public-domain", 0.4),
    "all rights reserved": ("all-rights-reserved", 0.5),
}
_TAG = " spdx license identifier "
_MARK = re.compile(r"(?i)spdx[-\s]license[-\s]identifier\s*:?\s*")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
# What may stand between tokens of one line, and a line break with the comment mark of the next line.
_BETWEEN = re.compile(r"[^A-Za-z0-9.+:()\r\n\"'<>*-]*")
_BREAK = re.compile(r"[\r\n]\s*(?:[*#;%]+|//+|--+)?(?![*#;%])")
# Tighter operators first.
_BINDING = {"with": 3, "and": 2, "or": 1}


def parse(text: str, at: int = 0) -> tuple[list[str], int]:
    """Licence ids and operators in postfix order, by the shunting-yard algorithm, and where they end.

    Reading starts at ``at`` and stops where no expression continues; line breaks are passed inside
    brackets only.  An operator without its operand is left out.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether one is due
    depth = 0
    end = at
    while True:
        at = _BETWEEN.match(text, at).end()
        while depth and (wrapped := _BREAK.match(text, at)):
            at = _BETWEEN.match(text, wrapped.end()).end()
        match = _TOKEN.match(text, at)
        if not match:
            break
        token = match[0]
        word = token.lower()
        if word in _BINDING:
            if operand:
                break
            while stack and stack[-1] != "(" and _BINDING[stack[-1]] >= _BINDING[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        elif token == "(":
            if not operand:
                break
            stack.append(token)
            depth += 1
        elif token == ")":
            if operand or not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        else:
            if not operand or word.rstrip(":") == "spdx-license-identifier":
                break
            out.append(word.rstrip(".:-"))
            operand = False
        at = end = match.end()
    rest = [t for t in reversed(stack) if t != "("]
    # The operator that waited for an operand is the last one put on the stack.
    return out + (rest[1:] if operand and rest else rest), end


def postfix(expression: str) -> list[str]:
    """Licence ids and operators of an expression in postfix order."""
    return parse(expression)[0]


def evaluate(tokens: list[str]) -> tuple[str, set[str]]:
    """An expression in postfix order written with the fewest brackets, and its labels.

    A licence and its exception are one label.  Alternatives are not expanded, so an expression
    takes as much time and room as it is long.
    """
    values: list[tuple] = []  # trees (an id or an operator with two trees) and their labels
    for token in tokens:
        if token not in _BINDING:
            values.append((token, {token} if token else set()))
            continue
        (right, more), (left, labels) = values.pop(), values.pop()
        if not labels or not more:
            values.append((left, labels) if labels else (right, more))
            continue
        if token == "with" and isinstance(right, str) and not any(" " in x for x in labels):
            labels = {f"{x} with {right}" for x in labels}
        else:
            labels, more = (labels, more) if len(labels) > len(more) else (more, labels)
            labels |= more
        values.append(((token, left, right), labels))
    if not values or not values[-1][1]:
        return "", set()
    tree, labels = values[-1]
    parts: list[str] = []
    todo: list[tuple] = [(tree, 0)]
    while todo:
        node, binding = todo.pop()
        if isinstance(node, str):
            parts.append(node)
        else:
            own = _BINDING[node[0]]
            inner = [(node[1], own), (f" {node[0]} ", 0), (node[2], own)]
            todo += ([("(", 0), *inner, (")", 0)] if own < binding else inner)[::-1]
    return "".join(parts), labels


def choices(expression: str) -> list[frozenset[str]]:
    """The alternatives an expression allows, each the set of licences that hold together.

    Their number may grow with a power of the length; scans use ``evaluate``.
    """
    values: list[list[frozenset[str]]] = []
    for token in postfix(expression):
        if token not in _BINDING:
            values.append([frozenset([token])] if token else [])
            continue
        right, left = values.pop(), values.pop()
        if token == "or":
            both = left + right
        elif token == "and":
            both = [a | b for a in left for b in right]
        else:
            both = [frozenset(f"{x} with {y}" for x in a for y in b) for a in left for b in right]
        # Alternatives that hold all of another one add nothing, and products stay small.
        distinct = sorted(set(both), key=lambda s: (len(s), sorted(s)))
        values.append(_least(distinct))
    return values[-1] if values else []


def _least(sets: list[frozenset[str]]) -> list[frozenset[str]]:
    out: list[frozenset[str]] = []
    for s in sets:
        if not any(o <= s for o in out):
            out.append(s)
    return out


def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for phrase, label in BASE.items():
        automaton.add_word(f" {phrase} ", ("base", label, len(phrase) + 2, 0.9))
    for phrase, (label, sure) in NOTICES.items():
        automaton.add_word(f" {phrase} ", ("notice", label, len(phrase) + 2, sure))
    automaton.add_word(_TAG, ("tag", "", len(_TAG), 0.0))
    automaton.make_automaton()
    return automaton


def read(text: bytes | None, automaton: ahocorasick.Automaton) -> tuple:
    """``(n_words, n_base, first, last, base labels, labels, score, expressions)`` of one text."""
    words = plain_words(text)
    # Bytes as characters of the same number; the patterns are ASCII.
    joined = f" {b' '.join(words).decode('latin-1')} "
    base_labels: set[str] = set()
    labels: set[str] = set()
    n_base, first, last, score, tagged = 0, None, None, 0.0, False
    counted, upto = 0, 0
    starts = []
    for end, (kind, label, length, sure) in automaton.iter(joined):
        score = max(score, sure)
        if kind == "tag":
            tagged = True
            continue
        labels.add(label)
        if kind == "base":
            base_labels.add(label)
            n_base += 1
            starts.append(end - length + 1)
    for start in sorted(starts):
        counted += joined.count(" ", upto, start)
        upto = start
        first = counted if first is None else first
        last = counted
    expressions: list[str] = []
    if tagged:
        read_on = text.decode("utf-8", "replace")
        mark = _MARK.search(read_on)
        while mark:
            tokens, end = parse(read_on, mark.end())
            expression, found = evaluate(tokens)
            if found:
                score = 1.0
                expressions.append(expression)
                labels |= found
            mark = _MARK.search(read_on, end)
    return (
        len(words), n_base, first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, expressions,
    )


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, expressions array<string>"
)


def scan(docs: DataFrame) -> DataFrame:
    """Licences of every row of ``docs(doc_id, text)``, without a shuffle.

    ``first_word`` and ``last_word`` are the first and last start of a base phrase, null without one.
    ``score`` is 1 for a parsed expression, else how sure the surest notice makes a licence, else 0.
    A null or empty text has no words.  Other columns are ignored; rows may repeat.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            rows = [read(t, automaton) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        work, SCHEMA
    )
