"""Personal data: patterns for direct identifiers, information theory for what gives them away.

* **Base spans**: e-mail and IP addresses, card and phone numbers, by fixed patterns and checks.
* **Disclosing terms.** Each distinct identifier is a protected entity.  Over the whole corpus the
  words near its mentions and the documents that hold it are counted.  A term ``t`` discloses an
  entity ``e`` by ``log2(P(e | t) / P(e))`` bits, where ``P(e | t)`` is the share of the documents
  with ``t`` that hold ``e``.  Terms that occur near an entity in several documents, make the
  entity likely and disclose more than a threshold of bits are found wherever they stand.
* **Sanitising.** Identifiers are generalised to their kind; terms that leave no doubt are removed,
  others generalised to a placeholder.

Mentions and terms meet by joins and grouped counts; nothing of the corpus is broadcast but a
filter of fixed size.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import MaybeWords
from lodestone.session import checkpoint

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits are entered at their start only: a match from within would also be one from there.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{4,40}")
_NEAR = 8
_COUNTED = 300_000


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their ``@``: a local part holds none, so it starts after the last."""
    out, begin = [], 0
    at = text.find("@")
    while at >= 0:
        run = text[begin:at]
        local = len(run) - len(run.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            out.append((at - local, domain.end()))
            begin = domain.end()
            at = text.find("@", begin)
        else:
            begin = at + 1
            at = text.find("@", begin)
    return out


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _part(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans in code points, by kind in the order of ``KINDS``."""
    emails = _emails(text) if "@" in text else []
    ips = [m.span() for m in _IP.finditer(text) if all(_part(p) for p in m[0].split("."))]
    cards = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                cards.append(m.span())
    phones = []
    if "+" in text:
        phones = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return [emails, ips, cards, phones]


def _written(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, part in zip(KINDS, spans, strict=True) for a, b in part)


def _entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind == 'email' else _digits(value) if kind != 'ip' else value}"


def _free_terms(text: str, spans: list[list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """Words that may disclose: letters only, outside of base spans."""
    taken = sorted(s for part in spans for s in part)
    out, i = [], 0
    for m in _TERM.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i == len(taken) or taken[i][0] >= m.end():
            out.append((m[0].lower(), m.start(), m.end()))
    return out


def base(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, n_email, n_ip, n_card, n_phone, base, near)`` per row of ``docs(row, doc_id, text)``.

    ``near`` holds the entities of the text and the terms within eight terms of a mention.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            written, near = [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text or "")
                for i, part in enumerate(spans):
                    counts[i].append(len(part))
                written.append(_written(spans))
                near.append(_mentions(text, spans) if written[-1] else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts],
                    pa.array(written, pa.string()),
                    pa.array(near, pa.list_(pa.struct([("entity", pa.string()), ("terms", pa.list_(pa.string()))]))),
                ],
                ["row", "doc_id", *[f"n_{k}" for k in KINDS], "base", "near"],
            )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("row", "doc_id", "text").mapInArrow(
        work, f"row long, doc_id long, {counts}, base string, near array<struct<entity:string,terms:array<string>>>"
    )


def _mentions(text: str, spans: list[list[tuple[int, int]]]) -> list[dict]:
    terms = _free_terms(text, spans)
    starts = [t[1] for t in terms]
    near: dict[str, set[str]] = {}
    for kind, part in zip(KINDS, spans, strict=True):
        for a, b in part:
            at = bisect.bisect_left(starts, a)
            around = terms[max(0, at - _NEAR) : at + _NEAR]
            near.setdefault(_entity(kind, text[a:b]), set()).update(t[0] for t in around)
    return [{"entity": e, "terms": sorted(t)} for e, t in sorted(near.items())]


def _occurrences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(row, term, at)``: where terms that may be in ``wanted(term)`` stand, outside of base spans."""
    bits = MaybeWords.bits_of(wanted, F.col("term"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = MaybeWords(bits)
        for batch in batches:
            rows, terms, places = [], [], []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text or not any(map(maybe.__getitem__, _TERM.findall(text.lower()))):
                    continue
                found: dict[str, list[dict]] = {}
                for term, a, b in _free_terms(text, base_spans(text)):
                    if maybe[term]:
                        found.setdefault(term, []).append({"a": a, "b": b})
                rows += [row] * len(found)
                terms += found
                places += found.values()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, pa.int64()), pa.array(terms, pa.string()),
                    pa.array(places, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                ],
                ["row", "term", "at"],
            )

    return docs.select("row", "text").mapInArrow(work, "row long, term string, at array<struct<a:int,b:int>>")


def _row(docs: DataFrame) -> DataFrame:
    """A name for every row: rows equal in id and text are alike in all results."""
    return docs.select(
        F.xxhash64(F.col("doc_id").cast("string"), "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )


def _frequencies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(term, n_t)``: the number of rows with each term that may be in ``wanted(term)``."""
    bits = MaybeWords.bits_of(wanted, F.col("term"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = MaybeWords(bits)
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(w for w in set(_TERM.findall(text.lower())) if maybe[w])
            if len(counts) > _COUNTED:
                yield _count_batch(counts)
                counts.clear()
        yield _count_batch(counts)

    return docs.select("text").mapInArrow(work, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def _count_batch(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"]
    )


def scan(docs: DataFrame, least: int = 3, likely: float = 0.5, bits: float = 6.0) -> DataFrame:
    """``(row, doc_id, n_<kind>..., base, terms)`` per row of ``docs(doc_id, text)``.

    ``terms`` lists the spans of disclosing terms with their bits and shares, by start.  A term must
    stand near the entity in ``least`` rows, be followed by it in a share ``likely`` of its rows and
    tell ``bits`` bits.  Null and empty texts hold nothing; every row counts in the statistics, also
    one that repeats another.  Other columns are ignored.
    """
    source = _row(docs)
    found = checkpoint(base(source))
    mentions = found.where("size(near) > 0").select(F.explode("near").alias("m")).select(
        F.col("m.entity").alias("entity"), F.col("m.terms").alias("terms")
    )
    held = mentions.groupBy("entity").agg(F.count("*").alias("n_e"))
    pairs = checkpoint(
        mentions.select("entity", F.explode("terms").alias("term")).groupBy("term", "entity")
        .agg(F.count("*").alias("n_te")).where(F.col("n_te") >= least)
    )
    counts = ["doc_id", *[f"n_{k}" for k in KINDS], "base"]
    none = F.array().cast("array<struct<a:int,b:int,bits:double,share:double>>")
    share = F.col("n_te") / F.col("n_t")
    told = F.log2(share * found.count() / F.col("n_e"))
    telling = checkpoint(
        pairs.join(held, "entity").join(_frequencies(source, pairs), "term")
        .withColumn("share", share).withColumn("bits", told)
        .where((F.col("share") >= likely) & (F.col("bits") >= bits))
        .groupBy("term").agg(F.max("bits").alias("bits"), F.max("share").alias("share"))
    )
    if telling.isEmpty():
        return found.select("row", *counts, none.alias("terms"))
    spans = (
        _occurrences(source, telling).distinct().join(telling, "term")
        .select("row", F.transform("at", lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.col("bits"), F.col("share"))).alias("s"))
        .groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("terms"))
    )
    return found.join(spans, "row", "left").select("row", *counts, F.coalesce("terms", none).alias("terms"))


def report(scanned: DataFrame) -> DataFrame:
    """Counts, the digest of base spans and all spans as text."""
    listed = F.array_join(F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["a"], t["b"])), ",")
    every = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("terms") > 0, listed))
    return scanned.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), every.alias("spans")
    )


def sanitised(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with all columns and a clean ``text``: identifiers become ``[KIND]``, terms that stand for
    one entity in 0.9 of their documents go, other disclosing terms become ``[TERM]``."""
    spans = scan(docs, **thresholds).where("base != '' or size(terms) > 0").select(
        F.col("row").alias("__row"), F.col("base").alias("__base"), F.col("terms").alias("__terms")
    ).dropDuplicates(["__row"])
    name = F.xxhash64(F.col("doc_id").cast("string"), "text")
    joined = docs.join(spans, name == F.col("__row"), "left")

    @F.pandas_udf("string")
    def clean(texts, written, terms):
        import pandas as pd

        out = []
        for text, listed, told in zip(texts, written, terms, strict=True):
            cuts = [(int(a), int(b), f"[{k.upper()}]") for k, a, b in (x.split(":") for x in listed.split(",") if x)]
            cuts += [(t["a"], t["b"], "" if t["share"] >= 0.9 else "[TERM]") for t in told]
            at, kept = 0, []
            for a, b, instead in sorted(cuts):
                if b > at:
                    kept += [text[at : max(at, a)], instead if a >= at else ""]
                    at = b
            out.append("".join([*kept, text[at:]]))
        return pd.Series(out)

    touched = joined.where("__row is not null").withColumn("text", clean("text", "__base", "__terms"))
    return joined.where("__row is null").select(docs.columns).unionByName(touched.select(docs.columns))
