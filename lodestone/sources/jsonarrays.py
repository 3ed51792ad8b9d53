"""Arrays of one JSON file of any size, read by as many tasks as the file has splits.

The file is read as lines that end at quotation marks, which Spark splits by
byte ranges like any text.  Whether a line lies inside a string, how deep the
brackets are and which element of which array it belongs to are running sums
over the lines: sums of the splits first, then within each split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.session import checkpoint

_PLACE = ["block", "line", "part"]
# Parts of what stands outside strings: brackets, commas and colons alone, anything else together.
_MARKS = r"([{}\[\],:]|[^{}\[\],:]+)"


def _before(rows: DataFrame, amounts: dict[str, Column], inclusive: bool) -> DataFrame:
    """Running sums over all rows in order of their places, with or without the own row."""
    each = rows.withColumns({f"__{name}": amount.cast("long") for name, amount in amounts.items()})
    totals = each.groupBy("block").agg(*[F.sum(f"__{name}").alias(f"__{name}") for name in amounts])
    # One row per split of the file.
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "block", *[F.coalesce(F.sum(f"__{name}").over(earlier), F.lit(0)).alias(f"__o_{name}") for name in amounts]
    )
    own = Window.partitionBy("block").orderBy(*_PLACE).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    summed = {
        name: F.col(f"__o_{name}") + F.coalesce(F.sum(f"__{name}").over(own), F.lit(0)) for name in amounts
    }
    joined = each.join(offsets, "block").withColumns(summed)
    return joined.drop(*[f"__{name}" for name in amounts], *[f"__o_{name}" for name in amounts])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(block, line, value, quoted)``: what stands between two quotation marks, and whether in a string."""
    read = spark.read.text(path, lineSep='"').select(
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.lit(0).alias("part"), "value",
    )
    read = checkpoint(read)
    # A mark behind an odd number of backslashes belongs to its string.
    slashes = F.length("value") - F.length(F.rtrim(F.col("value"), F.lit("\\")))
    counted = _before(read, {"marks": (slashes % 2 == 0).cast("int")}, inclusive=False)
    return checkpoint(counted.select("block", "line", "value", (F.col("marks") % 2 == 1).alias("quoted")))


def json_array_items(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """``(key, item_no, item)``: the elements of the arrays under ``keys`` of the object in the file, as JSON text.

    ``item_no`` counts from 0 in file order.  Keys that are missing or hold no
    array give no rows, and neither do empty arrays; of a repeated key the last
    array counts.  The file is taken to be valid, its keys to hold no escaped marks.
    """
    lines = _lines(spark, path)
    outside = F.regexp_extract_all("value", F.lit(_MARKS), F.lit(1))
    parts = lines.select(
        "block", "line", "quoted",
        F.posexplode(F.when(F.col("quoted"), F.array("value")).otherwise(outside)).alias("part", "text"),
    )
    free = ~F.col("quoted")
    opens, closes = free & F.col("text").isin("{", "["), free & F.col("text").isin("}", "]")
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    deep = _before(parts, {"depth": step}, inclusive=True)
    # Items follow the bracket that opens an array of the object, or a comma in it.
    starts = free & (F.col("depth") == 2) & ((F.col("text") == "[") | (F.col("text") == ","))
    # The string before an opening bracket at depth two is its key.
    named = F.col("quoted") & (F.col("depth") == 1)
    marked = checkpoint(
        _before(checkpoint(deep), {"item": starts.cast("int"), "name": named.cast("int")}, inclusive=True)
    )
    names = marked.where(named).select("name", F.col("text").alias("key")).where(F.col("key").isin(*keys))
    arrays = marked.where(starts & (F.col("text") == "[")).select("name")
    # One row per key.
    last = names.join(arrays, "name", "left_semi").groupBy("key").agg(F.max("name").alias("name"))
    inside = marked.join(F.broadcast(last), "name").where((F.col("depth") >= 2) & ~starts)
    piece = F.struct(*_PLACE, "quoted", "text")
    held = inside.groupBy("key", "item").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    # A string's lines are joined by the marks that stood between them; its ends are marks as well.
    mark = lambda there: F.when(there, F.lit('"')).otherwise(F.lit(""))
    quoted = lambda at: F.coalesce(F.get("pieces", at)["quoted"], F.lit(False))
    said = F.transform("pieces", lambda p, i: F.concat(mark(p["quoted"] | quoted(i - 1)), p["text"]))
    text = F.concat(F.array_join(said, ""), mark(quoted(F.size("pieces") - 1)))
    items = held.select("key", "item", F.regexp_replace(text, r"^\s+|\s+$", "").alias("item_text"))
    items = items.where(F.col("item_text") != "")
    base = items.groupBy("key").agg(F.min("item").alias("first_item"))
    return items.join(F.broadcast(base), "key").select(
        "key", (F.col("item") - F.col("first_item")).alias("item_no"), F.col("item_text").alias("item")
    )
