"""Extraction replies to edges and triplets: parsing, validity, first-wins deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import strip_ws
from lodestone.operators.ranking import first_per_key
from lodestone.session import spread_small_scan

_EDGE_FIELDS = ("subject", "predicate", "object")
_TRIPLET_FIELDS = ("subject", "predicate", "description", "object")


def parse_array(reply: Column) -> Column:
    """The reply as ``array<variant>``; an empty array unless it is one JSON array.

    A missing reply counts as ``[]``.  The parser ignores text after the first
    value, so the reply is parsed inside an object and inside an array: trailing
    text breaks at least one of the two.
    """
    text = F.when(reply == "", F.lit("[]")).otherwise(F.coalesce(reply, F.lit("[]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"r":'), text, F.lit("}")))
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    wrapped = F.try_variant_get(in_array, "$", "array<variant>")
    value = F.try_variant_get(in_object, "$.r", "array<variant>")
    valid = in_object.isNotNull() & (F.size(wrapped) == 1) & value.isNotNull()
    return F.when(valid, value).otherwise(F.array().cast("array<variant>"))


def _items(replies: DataFrame, *keep: str) -> DataFrame:
    replies = spread_small_scan(replies.select(*keep, "reply"), keep[0])
    return replies.select(*keep, F.posexplode(parse_array(F.col("reply"))).alias("item_no", "item")).where(
        F.schema_of_variant("item").startswith("OBJECT")
    )


def _field(name: str) -> Column:
    return F.variant_get("item", f"$.{name}", "variant")


def parse_edges(replies: DataFrame) -> DataFrame:
    """``(doc_id, item_no, subject, predicate, object)`` of replies ``(doc_id, reply)``.

    Items must be objects whose three fields are non-blank *strings*; the fields
    are stripped.
    """
    items = _items(replies, "doc_id")
    typed = items
    for name in _EDGE_FIELDS:
        is_text = F.schema_of_variant(_field(name)) == "STRING"
        value = F.when(is_text, strip_ws(F.variant_get("item", f"$.{name}", "string")))
        typed = typed.withColumn(name, value)
    ok = F.lit(True)
    for name in _EDGE_FIELDS:
        ok = ok & (F.length(name) > 0)
    return typed.where(ok).select("doc_id", "item_no", *_EDGE_FIELDS)


def _truthy_text(name: str) -> Column:
    """A field as text if it is truthy: non-empty text, non-zero number, true, non-empty container."""
    kind = F.schema_of_variant(_field(name))
    text = F.variant_get("item", f"$.{name}", "string")
    number = F.try_variant_get("item", f"$.{name}", "double")
    is_text = kind == "STRING"
    is_bool = kind == "BOOLEAN"
    is_number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    is_container = kind.rlike("^(ARRAY|OBJECT)")
    return (
        F.when(is_text, F.when(text != "", text))
        .when(is_bool, F.when(text == "true", F.lit("True")))
        .when(is_number, F.when(number != 0, text))
        .when(is_container, F.when(~text.isin("[]", "{}"), text))
    )


def parse_triplets(replies: DataFrame, *keep: str) -> DataFrame:
    """``(*keep, item_no, subject, predicate, description, object)`` of rows with a ``reply``.

    Items must be objects whose four fields are truthy; values are turned into
    text and stripped.
    """
    items = _items(replies, *keep)
    typed = items
    for name in _TRIPLET_FIELDS:
        typed = typed.withColumn(name, strip_ws(_truthy_text(name)))
    ok = F.lit(True)
    for name in _TRIPLET_FIELDS:
        ok = ok & F.col(name).isNotNull()
    return typed.where(ok).select(*keep, "item_no", *_TRIPLET_FIELDS)


def dedup_edges(edges: DataFrame, order: str = "eid") -> DataFrame:
    """First of every (subject, predicate, object), compared case-sensitively."""
    return (
        edges.groupBy("subject", "predicate", "object")
        .agg(F.min(order).alias(order))
        .select(order, "subject", "predicate", "object")
    )


def dedup_triplets(triplets: DataFrame, order: str = "ord") -> DataFrame:
    """First of every (subject key, description, object key); the relation plays no part.

    Expects ``subject_key`` and ``object_key``.  Descriptions are compared in
    lower case without surrounding white space.
    """
    keyed = triplets.withColumn("__desc", strip_ws(F.lower("description")))
    first = first_per_key(keyed, ["subject_key", "__desc", "object_key"], [F.asc(order)])
    return first.drop("__desc")
