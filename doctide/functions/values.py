"""Small column functions that documents need: merging, picking, parsing and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_range(start: Column, end: Column) -> Column:
    """Whole numbers from start up to, but not including, end; empty if there are none."""
    return F.when(end > start, F.sequence(start.cast("long"), end.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))


def merge_maps(base: Column, over: Column) -> Column:
    """Both maps' entries; where both have a key, the second's value, even null, wins."""
    return F.map_zip_with(F.coalesce(base, F.create_map().cast("map<string,string>")), F.coalesce(over, F.create_map().cast("map<string,string>")), lambda k, a, b: F.when(F.map_contains_key(over, k), b).otherwise(a))


def concat_arrays(*arrays: Column) -> Column:
    """The arrays one after another; a null one counts as empty."""
    return F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])


def clean_map(nested: Column) -> Column:
    """Without keys whose JSON text is null, blank or an empty object; empty arrays stay."""
    return F.map_filter(nested, lambda _, v: v.isNotNull() & ~F.trim(v).isin("", "null", "{}"))


def json_type(text: Column) -> Column:
    """The type of a JSON text: array, object, string, number, bool, null, or missing where it can't be read."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return (
        F.when(kind.isNull(), "missing").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "bool").when(kind == "VOID", "null").otherwise("number")
    )


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """What a group of the first match holds, null without a match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def tail_after(text: Column, prefix: Column) -> Column:
    """The text after a prefix that it begins with; else null. Lengths are code points."""
    return F.when(text.startswith(prefix), F.substring(text, F.length(prefix) + 1, F.length(text)))


def typed_json(text: Column) -> Column:
    """A literal as JSON text: whole number, decimal, true or false as they are, anything else a string; empty and ``null`` give null."""
    said = F.trim(text)
    number = said.rlike(r"^-?(0|[1-9]\d{0,17})$") | said.rlike(r"^-?(0|[1-9]\d*)\.\d+([eE][-+]?\d+)?$")
    quoted = F.regexp_replace(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", "$1")
    return F.when(~F.coalesce(said, F.lit("")).isin("", "null"), F.when(number | said.isin("true", "false"), said).otherwise(quoted))


def instant(text: Column) -> Column:
    """A past instant given as ``yyyyMMddHHmmss`` in the session's zone (UTC); null where it can't be read."""
    return F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss"))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
