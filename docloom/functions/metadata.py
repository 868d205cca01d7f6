"""Values of metadata kept as JSON text or variants, read and merged with their types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(json: Column, key: str) -> Column:
    """The value of a key as text, whatever its type; null for none, null or no JSON."""
    return F.get_json_object(json, f"$.{key}")


def json_type(json: Column, key: str) -> Column:
    """string, number, boolean, array, object; null for none, null or no JSON."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant"))
    return (
        F.when(kind == "STRING", "string").when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
    )


def fields(typed: Column) -> Column:
    """A variant's fields as a map to variants; none for what is no object."""
    return F.coalesce(typed.try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))


def merged(typed: Column, more: Column) -> Column:
    """Two variants merged shallowly, the right side winning; values keep their types, nested ones whole. What is no object
    counts as an empty one."""
    left, right = fields(typed), fields(more)
    return F.to_variant_object(F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right))


def typed_merged(json: Column, more: Column) -> Column:
    """merged() of JSON texts as JSON text, keys in order. Text that is no JSON, or repeats a key, counts as an empty object."""
    return F.to_json(merged(F.try_parse_json(json), F.try_parse_json(more)))


def json_merged(json: Column, more: Column) -> Column:
    """Two objects merged shallowly, the right side winning, both read as maps of text: for metadata that is a map of text.
    typed_merged() keeps types."""
    left, right = (F.coalesce(F.from_json(x, "map<string,string>"), F.create_map().cast("map<string,string>")) for x in (json, more))
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)


def value(typed: Column, path: str, kind: str) -> Column:
    """What a path ("$.a.b[0]") of a variant holds, as a type; null where there is nothing or another type."""
    return F.try_variant_get(typed, path, kind)
