"""Constraints, closed schemas, coercion, schema inference and a preflight report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import sinks

EMAIL = "^.+@.+$"


def constraint(field: str, kind: str, bound=None) -> tuple[str, Column]:
    """A name and the condition that breaks it: not_null, min, max, email, min_length, max_length, min_size, max_size. Null breaks only not_null."""
    c = F.col(field)
    broken = {
        "not_null": lambda: c.isNull(), "min": lambda: c < bound, "max": lambda: c > bound, "email": lambda: ~c.rlike(EMAIL),
        "min_length": lambda: F.length(c) < bound, "max_length": lambda: F.length(c) > bound, "min_size": lambda: c.isNotNull() & (F.size(c) < bound), "max_size": lambda: c.isNotNull() & (F.size(c) > bound),
    }
    return f"{field}:{kind}", broken[kind]()


def violations(df: DataFrame, rules: Sequence[tuple[str, Column]], name: str = "violations") -> DataFrame:
    """Names of broken rules in an array column."""
    return df.withColumn(name, F.filter(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules]), lambda x: x.isNotNull()))


def split_invalid(df: DataFrame, mode: str = "quarantine", keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and quarantined rows; ``keep`` decides on invalid ones (mode keep takes all, reject raises on any)."""
    bad = F.size("violations") > 0
    if mode == "reject" and df.filter(bad).head(1):
        raise ValueError("rows break constraints")
    take = ~bad | (F.lit(True) if mode == "keep" else keep if keep is not None else F.lit(False))
    return df.filter(take).drop("violations"), df.filter(~take)


def undeclared_keys(raw: str, declared: Sequence[str]) -> Column:
    """Top-level keys of a JSON text column that the schema doesn't have."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(F.col(raw)), F.array().cast("array<string>")), F.array(*map(F.lit, declared))))


def undeclared_paths(raw: str, schema: T.StructType, at: str = "") -> Column:
    """Dotted names of keys that a closed schema doesn't have, at every level that declares fields."""
    text = F.col(raw) if not at else F.get_json_object(F.col(raw), "$." + at)
    declared = F.array(*[F.lit(f.name) for f in schema])
    own = F.transform(F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), declared), lambda k: F.concat(F.lit(at + "." if at else ""), k))
    inner = [undeclared_paths(raw, f.dataType, f"{at}.{f.name}" if at else f.name) for f in schema if isinstance(f.dataType, T.StructType)]
    return F.array_sort(F.concat(own, *inner))


def walk(df: DataFrame, raw: str) -> DataFrame:
    """All nodes of JSON texts, at any depth: the other columns, ``parts``, ``kind`` and ``value``.

    Parts are keys led by a dot, and ``[]`` for the elements of an array. Kinds: object, objects (an array that holds an
    object or an array), values (another array), scalar, empty (null, a blank string, an empty object or array). A level
    is written before the next is made from it, until a level holds nothing nested. Texts that can't be read have no nodes.
    """
    rest = [c for c in df.columns if c != raw]
    fields, items = F.try_variant_get("value", "$", "map<string,variant>"), F.try_variant_get("value", "$", "array<variant>")
    nested = lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull() | F.try_variant_get(v, "$", "array<variant>").isNotNull()
    text = F.try_variant_get("value", "$", "string")
    blank = F.is_variant_null("value") | (fields.isNotNull() & (F.size(fields) == 0)) | (items.isNotNull() & (F.size(items) == 0)) | (fields.isNull() & items.isNull() & (F.trim(text) == ""))
    kind = F.when(blank, "empty").when(fields.isNotNull(), "object").when(items.isNotNull(), F.when(F.exists(items, nested), "objects").otherwise("values")).otherwise("scalar")
    level = df.select(*rest, F.array().cast("array<string>").alias("parts"), F.try_parse_json(raw).alias("value")).filter("value IS NOT NULL")
    out: DataFrame | None = None
    while True:
        here = sinks.written(level.select(*rest, "parts", kind.alias("kind"), "value"), "walk")
        out = here if out is None else out.unionByName(here)
        open_ = here.filter("kind IN ('object', 'objects')")
        if open_.isEmpty():
            return out
        named = F.transform(F.map_entries(fields), lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("part"), e["value"].alias("value")))
        listed = F.transform(items, lambda v: F.struct(F.lit("[]").alias("part"), v.alias("value")))
        below = open_.select(*rest, "parts", F.explode(F.when(F.col("kind") == "object", named).otherwise(listed)).alias("__in"))
        level = below.select(*rest, F.concat("parts", F.array("__in.part")).alias("parts"), F.col("__in.value").alias("value"))


def coerce_leaves(df: DataFrame, raw: str) -> DataFrame:
    """key columns with ``path``, ``number``, ``day`` and ``instant`` for every leaf of a JSON text at any depth; elements of an array have its path."""
    rest = [c for c in df.columns if c != raw]
    nodes = walk(df, raw)
    items = F.when(F.col("kind") == "values", F.try_variant_get("value", "$", "array<variant>")).otherwise(F.array("value"))
    leaves = nodes.filter("kind NOT IN ('object', 'objects')").select(*rest, "parts", F.explode(items).alias("value"))
    path = F.array_join(F.transform(F.filter("parts", lambda p: p != "[]"), lambda p: F.substring(p, 2, F.length(p))), ".")
    # Whatever is empty is a leaf without a value.
    flat = leaves.select(*rest, path.alias("path"), F.try_variant_get("value", "$", "string").alias("value"))
    return flat.select(*rest, "path", *[c.alias(n) for n, c in coerce_dynamic(F.col("value")).items()])


#: Which kind of a path's values the merged document takes, the last of these that comes.
_MERGED = ("empty", "scalar", "object", "values", "objects")


def merge_documents(df: DataFrame, raw: str) -> DataFrame:
    """``document``: one JSON text with every path that any text has; no row if no text can be read.

    Objects are merged field by field, arrays of objects to an array of one object merged from all elements. Of different
    kinds at one path the fuller one stays: arrays of objects, other arrays, objects, scalars, then empty values. Of
    several arrays of values or scalars that of the least JSON text stays, so the order of rows doesn't matter. Values are
    counted out by path before they meet; what is put together then is as large as the merged document.
    """
    rank = sum((F.when(F.col("kind") == k, i).otherwise(0) for i, k in enumerate(_MERGED)), F.lit(0))
    nodes = walk(df.select(raw), raw).select("parts", rank.alias("rank"), F.when(F.col("kind").isin("scalar", "values", "empty"), F.to_json("value")).alias("text"))
    best = nodes.groupBy("parts").agg(F.max(F.struct("rank", F.lit(1).alias("one"))).alias("m"), *[F.min(F.when(F.col("rank") == i, F.col("text"))).alias(f"t{i}") for i in (0, 1, 3)])
    found = best.select("parts", F.col("m.rank").alias("rank"), F.when(F.col("m.rank") == 0, F.col("t0")).when(F.col("m.rank") == 1, F.col("t1")).when(F.col("m.rank") == 3, F.col("t3")).alias("text"))
    found = sinks.written(found, "merged")
    quoted = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", "$1")
    depth = found.agg(F.max(F.size("parts"))).first()[0] or 0
    level = found.filter(F.size("parts") == depth)
    for at in range(depth, 0, -1):
        last, up = F.element_at("parts", -1), F.slice("parts", 1, at - 1)
        said = F.when(last == "[]", F.col("text")).otherwise(F.concat(quoted(F.substring(last, 2, F.length(last))), F.lit(":"), F.col("text")))
        made = level.filter("text IS NOT NULL").groupBy(up.alias("up"), (last == "[]").alias("listed")).agg(F.array_join(F.array_sort(F.collect_list(said)), ",").alias("inner"))
        above = found.filter(F.size("parts") == at - 1).join(made, (F.col("parts") == F.col("up")) & (F.col("listed") == (F.col("rank") == 4)), "left")
        text = F.when(F.col("rank") == 4, F.concat(F.lit("["), F.col("inner"), F.lit("]"))).when(F.col("rank") == 2, F.concat(F.lit("{"), F.col("inner"), F.lit("}"))).otherwise(F.col("text"))
        level = above.select("parts", "rank", text.alias("text"))
    return level.select(F.coalesce("text", F.lit("{}")).alias("document"))


def schema_document(schema: T.StructType, rules: Sequence[tuple[str, str]] = (), closed: bool = True) -> dict:
    """A structured description of a declared model: types, nesting, arrays, required fields, whether unknown ones are allowed."""
    simple = {"string": "string", "bigint": "long", "int": "int", "double": "double", "boolean": "bool", "date": "date", "timestamp": "date"}

    def of(kind: T.DataType, at: str) -> dict:
        if isinstance(kind, T.StructType):
            need = [f.name for f in kind if (at + f.name, "not_null") in rules or not f.nullable]
            body: dict = {"type": "object", "properties": {f.name: of(f.dataType, f"{at}{f.name}.") for f in kind}}
            return body | ({"required": need} if need else {}) | ({"additionalProperties": False} if closed else {})
        if isinstance(kind, T.ArrayType):
            return {"type": "array", "items": of(kind.elementType, at)}
        return {"type": simple.get(kind.simpleString(), "any")}

    return of(schema, "")


def coerce_dynamic(text: Column) -> dict[str, Column]:
    """A dynamic value read as number, date and instant; strings shorter than 8 or not led by a digit stay text."""
    dated = (F.length(text) >= 8) & text.rlike("^[0-9]")
    return {
        "number": text.try_cast("double"), "day": F.when(dated & text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date")),
        "instant": F.when(dated & text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.try_to_timestamp(text)),
    }


#: Votes for a leaf's type in order; the first that all its values take is the type.
_KINDS = [
    ("timestamp", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?"), ("date", r"^\d{4}-\d{2}-\d{2}$"), ("int", r"^-?\d{1,9}$"), ("bigint", r"^-?\d{1,18}$"),
    ("double", r"^-?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$"), ("boolean", r"^(true|false)$"), ("array", r"(?s)^\[.*\]$"), ("object", r"(?s)^\{.*\}$"),
]


def infer_types(df: DataFrame, raw: str) -> DataFrame:
    """path, type and conflicts (values of another type) of the top-level leaves of a JSON text column, from all rows."""
    pairs = df.select(F.explode(F.from_json(F.col(raw), "map<string,string>")).alias("path", "value"))
    votes = pairs.groupBy("path").agg(F.count("value").alias("filled"), *[F.count(F.when(F.col("value").rlike(p), 1)).alias(k) for k, p in _KINDS])
    choice = F.coalesce(*[F.when((F.col(k) == F.col("filled")) & (F.col("filled") > 0), k) for k, _ in _KINDS], F.when(F.col("filled") == 0, "any"), F.lit("string"))
    return votes.select("path", choice.alias("type"), "filled", (F.col("filled") - F.greatest(*[F.col(k) for k, _ in _KINDS])).alias("conflicts"))


def infer_schema(df: DataFrame, raw: str) -> str:
    """One type that covers all documents, as DDL of a variant schema."""
    return df.agg(F.schema_of_variant_agg(F.try_parse_json(raw))).first()[0]


_SUPPORTED = (T.StringType, T.IntegerType, T.LongType, T.DoubleType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType, T.DecimalType, T.ArrayType, T.StructType, T.MapType, T.VariantType)


def check_supported(schema: T.StructType) -> None:
    for f in schema:
        if not isinstance(f.dataType, _SUPPORTED):
            raise TypeError(f"{f.name}: unsupported type {f.dataType.simpleString()}")
        if isinstance(f.dataType, T.StructType):
            check_supported(f.dataType)


def preflight(spark: SparkSession, tables: Mapping[str, tuple[DataFrame | None, T.StructType, str, Sequence[tuple[str, Column]]]]) -> DataFrame:
    """A row a table: whether it exists, how its schema differs, rows, repeated keys and broken rules."""
    rows = []
    for name, (df, schema, key, rules) in tables.items():
        if df is None:
            rows.append(spark.createDataFrame([(name, False, "", 0, 0, 0)], "name string, present boolean, schema_diff string, rows long, repeated_keys long, broken_rows long"))
            continue
        have = {f.name: f.dataType.simpleString() for f in df.schema}
        diff = ",".join(sorted(f"{f.name}:{have.get(f.name, 'missing')}" for f in schema if have.get(f.name) != f.dataType.simpleString()))
        broken = reduce(and_, [~F.coalesce(b, F.lit(False)) for _, b in rules], F.lit(True))
        by_key = df.withColumn("__ok", broken).groupBy(key).agg(F.count("*").alias("n"), F.count(F.when(~F.col("__ok"), 1)).alias("bad"))
        rows.append(by_key.agg(F.lit(name).alias("name"), F.lit(True).alias("present"), F.lit(diff).alias("schema_diff"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated_keys"), F.coalesce(F.sum("bad"), F.lit(0)).alias("broken_rows")))
    return reduce(DataFrame.unionByName, rows)
