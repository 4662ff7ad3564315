"""Statistically shaped documents from frequency tables, and a repeatable mutation of batches."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import typed_json
from ..sources import sinks
from .joins import weight_ranges, weighted_pick

Tables = Mapping[str, DataFrame]


def uniform(seed: int, name: str, id_col: str = "id") -> Column:
    """A repeatable number in [0, 1) for each row and name."""
    said = F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}:{name}"))
    return F.conv(F.substring(F.md5(said), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


#: Value macros by name: from the arguments as text, a uniform number and the row's id, the value as text. More may be added.
MACROS: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "ONEUP": lambda a, b, u, i: (i + 1).cast("string"),
    "INTEGER": lambda a, b, u, i: F.floor(a.try_cast("double") + u * (b.try_cast("double") - a.try_cast("double") + 1)).cast("string"),
    "DOUBLE": lambda a, b, u, i: (a.try_cast("double") + u * (b.try_cast("double") - a.try_cast("double"))).cast("string"),
    "DATE": lambda a, b, u, i: F.date_add(a.try_cast("date"), F.floor(u * (F.datediff(b.try_cast("date"), a.try_cast("date")) + 1)).cast("int")).cast("string"),
    "DATETIME": lambda a, b, u, i: F.date_format(F.timestamp_seconds(F.unix_timestamp(a.try_cast("timestamp")) + F.floor(u * ((F.unix_timestamp(b.try_cast("timestamp")) - F.unix_timestamp(a.try_cast("timestamp"))) / 60 + 1)) * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
}


def _once(c: Column, make: Callable[[Column], Column]) -> Column:
    """What ``make`` says of a column that it names several times, which is worked out once."""
    return F.get(F.transform(F.array(c), make), F.lit(0))


def picked_parts(text: Column) -> dict[str, Column]:
    """What a table's value says, told once for the table's row: its macro with two arguments, or its JSON text."""
    macro = F.coalesce(*[F.when(text.rlike(rf"^@{name}(\(.*\))?$"), F.lit(name)) for name in MACROS])
    args = F.transform(F.split(F.regexp_extract(text, r"^@\w+\((.*)\)$", 1), ","), lambda x: F.trim(x))
    plain = F.when(text.startswith("@JSON("), F.regexp_extract(text, r"(?s)^@JSON\((.*)\)$", 1)).otherwise(typed_json(text))
    return {"macro": macro, "a": F.get(args, F.lit(0)), "b": F.get(args, F.lit(1)), "json": F.when(macro.isNull(), plain)}


def macro_json(column: str, macros: Sequence[str], seed: int, id_col: str = "id") -> Column:
    """A picked value as JSON text: a macro expanded, ``@JSON`` as it is, an unknown one and any literal typed by its look.

    ``macros`` are those that the value's table has, by which rows are dealt out; the parts lie beside the value.
    """
    u = uniform(seed, column + "/macro", id_col)
    part = lambda p: F.col(f"`{column}!{p}`")
    value = F.lit(None).cast("string")
    for macro in macros:
        value = F.when(part("macro") == macro, MACROS[macro](part("a"), part("b"), u, F.col(id_col))).otherwise(value)
    return F.when(part("macro").isNotNull(), _once(value, typed_json)).otherwise(part("json")) if macros else part("json")


def generate(spark: SparkSession, count: int, tables: Tables, arrays: Mapping[str, Tables] | None = None, seed: int = 1, weight: str = "probability") -> DataFrame:
    """id and one JSON document a row: every table gives one row by weight, dotted names nest, empty and null values drop.

    ``@ARRAY(name,n)`` is an array of n documents made from the tables ``arrays[name]``; a field ``ROOT`` that holds an
    object replaces the document. Arrays are made for their own rows and gathered by document.
    """
    return documents(spark.range(count), tables, arrays or {}, seed, weight).select("id", "document")


def documents(ids: DataFrame, tables: Tables, arrays: Mapping[str, Tables], seed: int, weight: str) -> DataFrame:
    """The rows of ``ids`` (id, ...) with a document each."""
    docs = ids
    columns: list[str] = []
    macros: dict[str, list[str]] = {}
    for name, table in tables.items():
        fields = [c for c in table.columns if c != weight]
        # Any order of the rows gives the same odds, so a hash deals them out to buckets.
        bucket = F.conv(F.substring(F.md5(F.concat_ws("\x01", *[F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields])), 1, 2), 16, 10).cast("int")
        ranges, total = weight_ranges(sinks.written(table, "weights"), weight, fields, bucket)
        names = {f: f"{name}/{f}" for f in fields}
        texts = {a: F.col(f"`{f}`").cast("string") for f, a in names.items()}
        parts = [c.alias(f"{a}!{p}") for a, text in texts.items() for p, c in picked_parts(text).items()]
        # Written, a table's size is known, so that a small one is sent to the documents instead of these being shuffled.
        ranges = sinks.written(ranges.select("lo", "hi", *[c.alias(a) for a, c in texts.items()], *parts), "ranges")
        seen = ranges.agg(F.count("*").alias("__rows"), *[F.collect_set(f"`{a}!macro`").alias(a) for a in texts]).first()  # at most the known macros a column
        macros |= {a: sorted(seen[a]) for a in texts}
        cells = min(1 << 16, max(64, 4 * seen["__rows"]))
        docs = weighted_pick(docs.withColumn("__r", F.floor(uniform(seed, name) * F.lit(total))), "__r", ranges, total, cells).drop("__r", "lo", "hi")
        columns += names.values()
    for a in columns:
        for name, inner in arrays.items():
            docs = _with_array(docs, a, name, inner, arrays, seed, weight)
        made = macro_json(a, macros[a], seed)
        docs = docs.withColumn(a, F.coalesce(*[F.col(f"`{a}#{name}`") for name in arrays], made) if arrays else made)
    roots = [c for c in columns if c.endswith("/ROOT")]
    tree: dict = {}
    for c in columns:
        if c not in roots:
            at = tree
            *parents, leaf = c.split("/", 1)[1].split(".")
            for p in parents:
                at = at.setdefault(p, {})
            at[leaf] = c
    whole = F.to_json(F.struct(*_nested(tree))) if tree else F.lit("{}")
    root = F.coalesce(*[F.col(f"`{c}`") for c in roots]) if roots else F.lit(None).cast("string")
    return docs.select(*ids.columns, F.when(root.startswith("{"), root).otherwise(whole).alias("document"))


def _with_array(docs: DataFrame, column: str, name: str, inner: Tables, arrays: Mapping[str, Tables], seed: int, weight: str) -> DataFrame:
    """A column of JSON arrays for the rows whose picked value is ``@ARRAY(name,n)``."""
    length = F.regexp_extract(F.col(f"`{column}`"), rf"^@ARRAY\(\s*{name}\s*,\s*(\d+)\s*\)$", 1).try_cast("int")
    wanted = docs.filter(length.isNotNull()).select(F.col("id").alias("parent"), length.alias("n"))
    parts = wanted.filter("n > 0").select("parent", F.explode(F.sequence(F.lit(1), "n")).alias("pos")).withColumn("id", F.xxhash64("parent", F.lit(column), "pos"))
    others = {k: v for k, v in arrays.items() if k != name}
    made = documents(parts, inner, others, seed + 1, weight)
    listed = made.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("pos", "document"))).alias("items"))
    text = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["document"]), ","), F.lit("]"))
    return docs.join(listed.select(F.col("parent").alias("__parent"), text.alias("__array")), F.col("id") == F.col("__parent"), "left").withColumn(f"{column}#{name}", F.when(length.isNotNull(), F.coalesce("__array", F.lit("[]")))).drop("__parent", "__array")


def _nested(tree: dict) -> list[Column]:
    out = []
    for k, v in tree.items():
        if isinstance(v, dict):
            inner = F.to_json(F.struct(*_nested(v)))
            out.append(F.try_parse_json(_once(inner, lambda x: F.when(x != "{}", x))).alias(k))
        else:
            out.append(F.try_parse_json(F.col(f"`{v}`")).alias(k))
    return out


def mutate(df: DataFrame, key: str, rate: float, edits: Mapping[str, tuple[float, Callable[[Column], Column]]], seed: int = 1) -> DataFrame:
    """A share of rows is touched; of these each column's edit applies with its own rate. Repeatable by key."""
    hit = uniform(seed, "hit", key) < rate
    marks = {c: hit & (uniform(seed, c, key) < share) for c, (share, _) in edits.items()}
    return df.select(*[F.when(marks[c], edits[c][1](F.col(c))).otherwise(F.col(c)).alias(c) if c in edits else F.col(c) for c in df.columns])


def mutate_documents(df: DataFrame, key: str, number: str, flag: str, values: tuple[str, str], rate: float = 0.01, seed: int = 1, deleted: str = "deleted") -> DataFrame:
    """Of the rows touched, a tenth each: the number grows by a hundredth, the flag flips, the row is marked deleted, or, of the others, it gets a new id."""
    hit = uniform(seed, "hit", key) < rate
    tenth = lambda name: hit & (uniform(seed, name, key) < 0.1)
    gone = tenth("delete")
    flipped = F.when(F.col(flag) == values[0], values[1]).when(F.col(flag) == values[1], values[0]).otherwise(F.col(flag))
    moved = (F.col(key) * 100 + F.floor(uniform(seed, "id", key) * 100)).cast(df.schema[key].dataType)
    return df.select(
        F.when(tenth("move") & ~gone, moved).otherwise(F.col(key)).alias(key),
        *[F.when(tenth("number"), F.floor(F.col(c) * 101 / 100).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == number else F.when(tenth("flag"), flipped).otherwise(F.col(c)).alias(c) if c == flag else F.col(c) for c in df.columns if c != key],
        F.when(gone, F.lit(True)).alias(deleted),
    )
