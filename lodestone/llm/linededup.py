"""Line deduplication by winnowing, in DataFrame functions only.

The lines of a text that are not blank are hashed; a gram is the hash of ``gram`` consecutive
lines.  Of every ``window`` consecutive grams the smallest (the rightmost of equal ones) is a
fingerprint, so any run of ``gram + window - 1`` lines that occurs twice has a fingerprint at the
same place of both occurrences; with a window of 1 every gram is one.  A line of ``words`` words or
more is a fingerprint by itself.  Every later occurrence of a fingerprint meets its first, a linear
number of matches; a match extends along its diagonal while lines are equal, and the later run goes
if it has ``gram`` lines or a line of ``words`` words.

With a window of 1 a line goes exactly if it stands in a run of ``gram`` lines that occurs earlier,
or has ``words`` words and occurs earlier: the first holder of a gram holds all of it.

A place is earlier if its document has the smaller id (null last), or stands earlier in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import checkpoint

_LAST = (1 << 63) - 1
# Words of a line that goes although its neighbours do not repeat.
WORDS = 8


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))


def _name() -> Column:
    """Tells texts of one id apart; rows equal in id and text are one document."""
    return F.xxhash64("text")


def _filled(line: Column) -> Column:
    return F.trim(line) != ""


def _lines() -> Column:
    return F.split("text", "\n", -1)


def fingerprints(hashes: str, gram: int, window: int) -> Column:
    """Distinct ``(value, place)`` of the window minima of an array of line hashes."""
    h = F.col(hashes)

    def grams(h: Column) -> Column:
        return F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - gram + 1, F.lit(0))),
            lambda _, i: F.struct(
                F.xxhash64(*[F.element_at(h, i + 1 + j) for j in range(gram)]).alias("value"), (-i).alias("back")
            ),
        )

    def minima(g: Column) -> Column:
        return F.transform(
            F.slice(g, 1, F.greatest(F.size(g) - window + 1, F.least(F.size(g), F.lit(1)))),
            lambda _, i: F.array_min(F.slice(g, i + 1, window)),
        )

    # One-element arrays hold intermediate results, so that each is computed once.
    return F.array_distinct(F.flatten(F.transform(F.array(grams(h)), minima)))


def _long(line: Column, words: int) -> Column:
    return F.size(F.split(F.trim(line), r"\s+")) >= words


def repeated_runs(docs: DataFrame, gram: int = 2, window: int = 1, words: int = WORDS) -> DataFrame:
    """``(did, name, runs)``: per document with repeats, runs ``lo..hi`` of its lines that are not blank."""
    hashed = docs.where("text is not null").select(
        _id().alias("did"), _name().alias("name"),
        F.transform(
            F.filter(_lines(), _filled), lambda x: F.struct(F.xxhash64(F.trim(x)).alias("h"), _long(x, words).alias("long"))
        ).alias("lines"),
    ).where(F.size("lines") > 0).select(
        "did", "name", F.col("lines.h").alias("h"),
        F.filter(F.transform("lines", lambda x, i: F.when(x["long"], i)), F.isnotnull).alias("long"),
    )
    held = checkpoint(hashed.groupBy("did", "name").agg(F.first(F.struct("h", "long")).alias("f")).select("did", "name", "f.*"))
    alone = F.transform(
        "long", lambda i: F.struct(F.xxhash64(F.lit("line"), F.element_at("h", i + 1)).alias("value"), (-i).alias("back"))
    )
    places = held.select("did", "name", F.explode(F.concat(fingerprints("h", gram, window), alone)).alias("f")).select(
        "did", "name", F.col("f.value").alias("value"), (-F.col("f.back")).alias("at")
    )
    first = places.groupBy("value").agg(
        F.min(F.struct("did", "name", "at")).alias("first"), F.count("*").alias("n")
    ).where("n > 1").select(
        "value", F.col("first.did").alias("fdid"), F.col("first.name").alias("fname"), F.col("first.at").alias("fat")
    )
    later = places.join(first, "value").where("not (did = fdid and name = fname and at = fat)")
    diagonals = later.groupBy("did", "name", "fdid", "fname", (F.col("fat") - F.col("at")).alias("shift")).agg(
        F.collect_list("at").alias("hits")
    )
    origin = held.select(F.col("did").alias("fdid"), F.col("name").alias("fname"), F.col("h").alias("fh"))
    both = diagonals.join(origin, ["fdid", "fname"]).join(held, ["did", "name"])
    # Places of the later text whose line differs from its counterpart, with the ends as barriers.
    low = F.greatest(F.lit(0), -F.col("shift"))
    high = F.least(F.size("h"), F.size("fh") - F.col("shift"))
    barriers = F.concat(
        F.array(low - 1),
        F.filter(
            F.sequence(low, high - 1),
            lambda i: F.element_at("h", i + 1) != F.element_at("fh", i + F.col("shift") + 1),
        ),
        F.array(high),
    )
    gaps = F.transform(
        F.slice("barriers", 1, F.size("barriers") - 1),
        lambda b, i: F.struct((b + 1).alias("lo"), (F.element_at("barriers", i + 2) - 1).alias("hi")),
    )
    runs = F.filter(
        gaps,
        lambda r: ((r["hi"] - r["lo"] >= gram - 1) | F.exists("long", lambda p: (p >= r["lo"]) & (p <= r["hi"])))
        & F.exists("hits", lambda p: (p >= r["lo"]) & (p <= r["hi"])),
    )
    return (
        both.withColumn("barriers", barriers).select("did", "name", F.explode(runs).alias("run"))
        .groupBy("did", "name").agg(F.array_sort(F.collect_set("run")).alias("runs"))
    )


def without_repeats(docs: DataFrame, gram: int = 2, window: int = 1, words: int = WORDS) -> DataFrame:
    """``docs`` with all columns, ``text`` without later repeated runs, and ``__lines``, ``__removed``.

    ``__lines`` counts the lines that are not blank, ``__removed`` those of them that went; blank
    lines inside a run go with it.  Null and empty texts stay as they are, with 0 lines.  Rows
    equal in id and text are one document and share their result.  A null id comes after all others.
    """
    runs = repeated_runs(docs, gram, window, words).select(
        F.col("did").alias("__did"), F.col("name").alias("__name"), F.col("runs").alias("__runs")
    )
    joined = docs.join(runs, (_id() == F.col("__did")) & (_name() == F.col("__name")), "left")
    lines = _lines()
    filled = F.filter(F.sequence(F.lit(0), F.size("__all") - 1), lambda i: _filled(F.element_at("__all", i + 1)))
    removed = F.filter(
        F.sequence(F.lit(0), F.size("__filled") - 1),
        lambda i: F.exists("__runs", lambda r: (i >= r["lo"]) & (i <= r["hi"])),
    )
    spans = F.transform("__runs", lambda r: F.struct(
        F.element_at("__filled", r["lo"] + 1).alias("lo"), F.element_at("__filled", r["hi"] + 1).alias("hi")
    ))
    kept = F.filter("__all", lambda _, i: ~F.exists("__spans", lambda s: (i >= s["lo"]) & (i <= s["hi"])))
    hit = F.col("__runs").isNotNull()
    return (
        joined.withColumn("__all", lines)
        .withColumn("__filled", F.when(F.col("__all").isNotNull(), filled))
        .withColumn("__spans", F.when(hit, spans))
        .withColumn("__lines", F.when(F.col("__all").isNotNull(), F.size("__filled")).otherwise(0).cast("long"))
        .withColumn("__removed", F.when(hit, F.size(removed)).otherwise(0).cast("long"))
        .withColumn("text", F.when(hit, F.array_join(kept, "\n")).otherwise(F.col("text")))
        .select(*[F.col(f"`{c}`") for c in docs.columns], "__lines", "__removed")
    )
