"""Nesting look-ups, code tables, parent chains, unions and first rows by key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nest_lookup(left: DataFrame, right: DataFrame, key: str, other: str, name: str, order: Sequence[Column] | None = None) -> DataFrame:
    """All right rows of a left row as an array (empty if none). The right side is aggregated before the join; a group is one row's array."""
    item = F.struct(*order, F.struct("*").alias("row")) if order else F.struct(F.struct("*").alias("row"))
    many = right.select(F.col(other).alias("__key"), item.alias("__item")).groupBy("__key").agg(F.collect_list("__item").alias("__list"))
    many = many.select("__key", F.transform(F.array_sort("__list") if order else F.col("__list"), lambda x: x["row"]).alias(name))
    return left.join(many, left[key] == many["__key"], "left").drop("__key").withColumn(name, F.coalesce(name, F.array()))


def code_lookup(df: DataFrame, codes: DataFrame, key: str, code: str, value: str, name: str) -> DataFrame:
    """A code's text; the planner broadcasts the table if its size allows."""
    return code_lookups(df, codes, key, code, {value: name})


def code_lookups(df: DataFrame, codes: DataFrame, key: str, code: str, names: Mapping[str, str]) -> DataFrame:
    """Several columns of a code's row under other names, by one join; of rows of one code the first by these columns."""
    one = first_per_key(codes.select(F.col(code).alias("__code"), *[F.col(v).alias(n) for v, n in names.items()]), ["__code"], [F.col(n) for n in names.values()])
    return df.join(one, df[key] == one["__code"], "left").drop("__code")


def parent_chain(df: DataFrame, tree: DataFrame, key: str, node: str, parent: str, value: str, levels: int = 4, root: int = 0) -> DataFrame:
    """``{value}_1 .. {value}_n``: the node's own text, its parent's, and so on; the root id ends the chain."""
    at = df.withColumn("__at", F.col(key))
    for k in range(1, levels + 1):
        step = tree.filter(F.col(node) != root).select(F.col(node).alias("__node"), F.col(parent).alias("__up"), F.col(value).alias(f"{value}_{k}"))
        at = at.join(step, at["__at"] == step["__node"], "left").drop("__node", "__at").withColumnRenamed("__up", "__at")
    return at.drop("__at")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")


def whole_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two tables of documents by key, sorted and merged whatever their size seems to be.

    A column's share of a table's files is guessed from its type, of which a payload of variants takes nearly all: without
    the payload, millions of rows look small enough to be broadcast through the driver.
    """
    return left.join(right.hint("merge"), key)


def union_with(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right, allowMissingColumns=True)


def promote(df: DataFrame, column: str) -> DataFrame:
    return df.select(f"{column}.*")


def wrap(df: DataFrame, name: str = "root") -> DataFrame:
    return df.select(F.struct("*").alias(name))


def group_columns(df: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """Flat columns put under one object and dropped at the top."""
    return df.withColumn(name, F.struct(*columns)).drop(*columns)


def weight_ranges(table: DataFrame, weight: str, order: Sequence[str], bucket: Column) -> tuple[DataFrame, int]:
    """Cumulative ``lo`` and ``hi`` of truncated weights, and their total; rows of a weight below one go.

    ``bucket`` deals the rows out: sums run inside each, and one row a bucket is put in order. The running order is that of
    (bucket, order), so a bucket that grows with the order keeps it.
    """
    whole = table.withColumn("__w", F.col(weight).cast("double").cast("long")).filter("__w >= 1").withColumn("__b", bucket)
    sums = whole.groupBy("__b").agg(F.sum("__w").alias("__sum"))
    before = sums.select(F.col("__b").alias("__of"), (F.sum("__sum").over(Window.orderBy("__b")) - F.col("__sum")).alias("__before"))
    inside = F.sum("__w").over(Window.partitionBy("__b").orderBy(*[F.col(f"`{c}`") for c in order]).rowsBetween(Window.unboundedPreceding, 0))
    ranges = whole.withColumn("__in", inside).join(before, F.col("__b") == F.col("__of")).withColumn("hi", F.col("__before") + F.col("__in")).withColumn("lo", F.col("hi") - F.col("__w"))
    return ranges.drop("__w", "__b", "__of", "__before", "__in"), sums.agg(F.coalesce(F.sum("__sum"), F.lit(0))).first()[0]


def weighted_pick(draws: DataFrame, r: str, ranges: DataFrame, total: int, cells: int = 1 << 16) -> DataFrame:
    """The range row with lo <= r < hi, by equality on cells of the number line that a range covers, then its bounds."""
    width = max(1, -(-total // cells))
    covered = F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))
    sides = ranges.withColumn("__cell", covered)
    return draws.withColumn("__at", F.floor(F.col(r) / width)).join(sides, (F.col("__at") == F.col("__cell")) & (F.col(r) >= F.col("lo")) & (F.col(r) < F.col("hi"))).drop("__at", "__cell")


def conditional_lookup(df: DataFrame, details: DataFrame, key: str, other: str, when: Column, then: str, otherwise: str, name: str, order: Sequence[Column] = ()) -> DataFrame:
    """One detail row by key (the first by ``order``), of which one of two texts is taken by a condition on the left row; empty ones are null."""
    one = first_per_key(details.select(F.col(other).alias("__key"), F.col(then).alias("__then"), F.col(otherwise).alias("__else")), ["__key"], list(order) or [F.col("__then"), F.col("__else")])
    return df.join(one, df[key] == one["__key"], "left").withColumn(name, F.nullif(F.when(when, F.col("__then")).otherwise(F.col("__else")), F.lit(""))).drop("__key", "__then", "__else")
