"""Keyed upsert of document frames: insert, replace, patch and patch with history, deletes, versions and counters.

Current tables hold the declared columns, ``lock_version`` and ``previous`` (update id, time, changed paths with old
values). Incoming null means absent. One full join on the key does the whole batch; rows that don't change stay as
they are. A key that comes more than once in a batch is first collapsed in the order given; without an order the
batch must not repeat a key, and a repeated one fails it, as does a row without a key. INSERT fails on keys that exist
if ``conflicts`` is "fail". A key that is deleted and comes again in one batch starts anew at version 1: nothing of its
old row stays, and its change counts as an update that leads back to that row.

A change of an array keeps its old length and, as paths of their own (``items[3]``), the old elements that differ from
the new ones at the same place; arrays of elements that can't be compared are kept whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import first_per_key
from .quality import constraint, split_invalid, violations

STRATEGIES = ("REPLACE", "UPDATE", "UPDATEWITHHISTORY", "INSERT")
PREVIOUS = "struct<update_id:string,last_update:timestamp,changes:map<string,string>>"


def leaf_paths(schema: T.StructType, skip: set[str] = frozenset(), at: str = "") -> list[tuple[str, T.DataType]]:
    """Dotted paths of all leaves; arrays are leaves."""
    out: list[tuple[str, T.DataType]] = []
    for f in schema:
        path = at + f.name
        if path in skip:
            continue
        out += leaf_paths(f.dataType, skip, path + ".") if isinstance(f.dataType, T.StructType) else [(path, f.dataType)]
    return out


def rebuild(schema: T.StructType, leaf, at: str = "") -> list[Column]:
    """Columns of the schema with each leaf made by ``leaf(path, type)``; an object whose leaves are all null is null."""
    out = []
    for f in schema:
        path = at + f.name
        if isinstance(f.dataType, T.StructType):
            inner = rebuild(f.dataType, leaf, path + ".")
            filled = reduce(or_, [leaf(p, k).isNotNull() for p, k in leaf_paths(f.dataType, at=path + ".")])
            out.append(F.when(filled, F.struct(*inner)).alias(f.name))
        else:
            out.append(leaf(path, f.dataType).alias(f.name))
    return out


def _comparable(c: Column, kind: T.DataType) -> Column:
    """Maps and variants compare by their JSON with sorted keys."""
    if isinstance(kind, T.MapType):
        return F.to_json(F.map_from_entries(F.transform(F.array_sort(F.map_keys(c)), lambda k: F.struct(k, F.element_at(c, k)))))
    return F.to_json(c) if isinstance(kind, T.VariantType) else c


@dataclass
class Upsert:
    """What one batch makes: the next state, one row a change with its history, and counters."""

    state: DataFrame
    changes: DataFrame
    metrics: DataFrame


def _content(df: DataFrame, columns: Sequence[str]) -> Column:
    """A number of a row's content, which decides between rows of one place in the order."""
    kinds = {f.name: f.dataType for f in df.schema}
    return F.xxhash64(*[F.to_json(F.struct(c)) if isinstance(kinds[c], (T.MapType, T.VariantType, T.ArrayType, T.StructType)) else F.col(c) for c in columns])


def collapse(incoming: DataFrame, key: str, order: str, strategy: str, delete: str | None = None) -> DataFrame:
    """One row a key: the last one, or for patches the last non-null value of each path since the last delete.

    Of rows of one place in the order, that of the larger content hash is the last; equal rows are one. With a delete
    marker, patches get ``__fresh``: whether the key was deleted before the rows that its patch is made of. The marker
    itself is that of the last row; a delete counts as one where it is true.
    """
    other = [c for c in incoming.columns if c not in (key, order)]
    rows = incoming.withColumn("__at", F.struct(order, _content(incoming, other).alias("content")))
    if strategy in ("REPLACE", "INSERT"):
        return first_per_key(rows, [key], [F.col("__at").desc()]).drop("__at")
    doc = T.StructType([f for f in incoming.schema if f.name in other and f.name != delete])
    names = {path: f"__leaf{i}" for i, (path, _) in enumerate(leaf_paths(doc))}
    live = F.lit(True)
    if delete:
        # Per key the last delete, found on the partitioning that the fold needs anyway.
        rows = rows.withColumn("__end", F.max(F.when(F.col(delete).cast("boolean"), F.col("__at"))).over(Window.partitionBy(key)))
        rows = rows.filter(F.col("__end").isNull() | (F.col("__at") >= F.col("__end")))
        live = F.col("__end").isNull() | (F.col("__at") > F.col("__end"))
    folded = [F.max_by(path, F.when(live & F.col(path).isNotNull(), F.col("__at"))).alias(n) for path, n in names.items()]
    if delete:
        folded += [F.max_by(delete, "__at").alias(delete), F.max(F.col("__end").isNotNull()).alias("__fresh")]
    out = rows.groupBy(key).agg(F.max(order).alias(order), *folded)
    again = rebuild(doc, lambda path, _: F.col(names[path]))
    if not delete:
        return out.select(key, order, *again)
    fresh = F.col("__fresh") & ~F.coalesce(F.col(delete).cast("boolean"), F.lit(False))
    return out.select(key, order, delete, *again, fresh.alias("__fresh"))


def _compares(kind: T.DataType) -> bool:
    """Whether Spark's equality takes the type."""
    if isinstance(kind, T.ArrayType):
        return _compares(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_compares(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _old_elements(path: str, old: Column, new: Column) -> Column:
    """An array's old length under its path, and each old element that isn't the new one under a path of its own."""
    moved = F.filter(F.transform(old, lambda o, i: F.struct(i.alias("i"), o.alias("v"), (o.eqNullSafe(F.get(new, i)) & F.coalesce(i < F.size(new), F.lit(False))).alias("same"))), lambda x: ~x["same"])
    items = F.transform(moved, lambda x: F.struct(F.concat(F.lit(path + "["), x["i"].cast("string"), F.lit("]")).alias("k"), F.to_json(F.struct(x["v"].alias("v"))).alias("o")))
    length = F.array(F.struct(F.lit(path).alias("k"), F.to_json(F.struct(F.when(old.isNotNull(), F.size(old)).alias("n"))).alias("o")))
    return F.concat(length, F.coalesce(items, F.array().cast("array<struct<k:string,o:string>>")))


def upsert(current: DataFrame, incoming: DataFrame, key: str, strategy: str, batch_id: str, batch_ts: Column, delete: str | None = None, order: str | None = None, delete_when: str = "true", conflicts: str = "report") -> Upsert:
    """Apply a batch. ``delete`` names a marker column of the incoming frame; ``delete_when="present"`` takes any non-null."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    if delete:
        marked = F.col(delete).isNotNull() if delete_when == "present" else F.coalesce(F.col(delete).cast("boolean"), F.lit(False))
        incoming = incoming.withColumn(delete, marked)
    incoming = incoming.withColumn(key, F.coalesce(F.col(key), F.raise_error(F.lit(f"a row has no {key}")).cast(incoming.schema[key].dataType)))
    if order:
        incoming = collapse(incoming, key, order, strategy, delete).drop(order)
    else:
        # Checked as the rows are read: one group a key, on the partitioning that the join needs anyway.
        other = [c for c in incoming.columns if c != key]
        alone = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("a key comes twice and no order is given: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.first(F.struct(F.lit(1).alias("__one"), *other)))
        incoming = incoming.groupBy(key).agg(alone.alias("__row")).select(key, *[F.col(f"__row.{c}").alias(c) for c in other])
    book = {"lock_version", "previous"}
    doc = T.StructType([f for f in current.schema if f.name not in book])
    leaves = [(p, k) for p, k in leaf_paths(doc) if p != key]
    flag = F.coalesce(F.col(f"i.{delete}"), F.lit(False)) if delete else F.lit(False)
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in doc if f.name not in incoming.columns]
    new = incoming.select("*", *missing).withColumn("__in", F.lit(True)).alias("i")
    old = current.withColumn("__was", F.lit(True)).alias("c")
    both = old.join(new, F.col(f"c.{key}") == F.col(f"i.{key}"), "full_outer")
    was, comes = F.coalesce(F.col("c.__was"), F.lit(False)), F.coalesce(F.col("i.__in"), F.lit(False))
    fresh = F.coalesce(F.col("i.__fresh"), F.lit(False)) if "__fresh" in incoming.columns else F.lit(False)
    differs = {p: ~_comparable(F.col(f"i.{p}"), k).eqNullSafe(_comparable(F.col(f"c.{p}"), k)) for p, k in leaves}
    if strategy == "REPLACE":
        changed = reduce(or_, differs.values(), F.lit(False)) | ~F.col("c.lock_version").eqNullSafe(F.lit(1)) | F.col("c.previous").isNotNull()
    else:
        differs = {p: (F.col(f"i.{p}").isNotNull() | fresh) & d for p, d in differs.items()}
        changed = reduce(or_, differs.values(), F.lit(False)) | fresh
    action = (
        F.when(comes & flag, F.when(was, "delete")).when(comes & ~was, "insert")
        .when(comes & was & F.lit(strategy == "INSERT"), "conflict").when(comes & changed, "update")
    )
    by_element = {p for p, k in leaves if isinstance(k, T.ArrayType) and _compares(k)}
    entries = F.array(*[F.struct(F.lit(p).alias("k"), differs[p].alias("d"), F.to_json(F.struct(F.col(f"c.{p}").alias("v"))).alias("o")) for p, _ in leaves if p not in by_element])
    none = F.array().cast("array<struct<k:string,o:string>>")
    moved = [F.when(differs[p], _old_elements(p, F.col(f"c.{p}"), F.col(f"i.{p}"))).otherwise(none) for p in sorted(by_element)]
    delta = F.map_from_entries(F.concat(F.transform(F.filter(entries, lambda e: e["d"]), lambda e: F.struct(e["k"], e["o"])) if len(by_element) < len(leaves) else none, *moved))
    plain = F.array(*[F.struct(F.lit(p).alias("k"), F.to_json(F.struct(F.col(f"c.{p}").alias("v"))).alias("o")) for p, _ in leaves])
    patch = strategy in ("UPDATE", "UPDATEWITHHISTORY")
    take = {p: F.when(comes, F.coalesce(F.col(f"i.{p}"), F.when(~fresh, F.col(f"c.{p}"))) if patch else F.when(F.lit(strategy == "INSERT") & was, F.col(f"c.{p}")).otherwise(F.col(f"i.{p}"))).otherwise(F.col(f"c.{p}")) for p, _ in leaves}
    take[key] = F.coalesce(F.col(f"c.{key}"), F.col(f"i.{key}"))
    nothing = F.lit(None).cast("map<string,string>")
    kept = F.when(F.col("__action") == "update", delta) if strategy == "UPDATEWITHHISTORY" else nothing
    if conflicts == "fail":
        action = F.when(action == "conflict", F.raise_error(F.concat(F.lit("key exists: "), F.col(f"i.{key}").cast("string"))).cast("string")).otherwise(action)
    both = both.withColumn("__action", action)
    version = F.when(F.col("__action") == "insert", F.lit(1)).when(F.col("__action") == "update", F.lit(1) if strategy == "REPLACE" else F.when(fresh, F.lit(1)).otherwise(F.coalesce("c.lock_version", F.lit(0)) + 1)).otherwise(F.col("c.lock_version")).cast("long")
    note = F.struct(F.when(F.col("__action") == "update", F.lit(batch_id)).alias("update_id"), batch_ts.cast("timestamp").alias("last_update"), kept.alias("changes")).cast(PREVIOUS)
    previous = F.when(F.col("__action").isin("insert", "update"), note if patch else F.lit(None).cast(PREVIOUS)).otherwise(F.col("c.previous"))
    gone = (F.col("__action") == "delete") | (~was & flag)
    state = both.filter(~F.coalesce(gone, F.lit(False))).select(*rebuild(doc, lambda p, _: take[p]), version.alias("lock_version"), previous.alias("previous"))
    content = F.when(F.col("__action") == "update", delta).when(F.col("__action") == "delete", F.map_from_entries(plain)).otherwise(nothing)
    changes = both.filter(F.col("__action").isNotNull()).select(take[key].alias("record_id"), F.col("__action").alias("type"), batch_ts.cast("timestamp").alias("ts"), F.lit(batch_id).alias("update_id"), content.alias("changes"))
    count = lambda kind: F.count(F.when(F.col("type") == kind, 1)).alias(f"{kind}s")
    return Upsert(state, changes, changes.agg(count("insert"), count("update"), count("delete"), count("conflict")))


def with_bookkeeping(df: DataFrame) -> DataFrame:
    """A plain frame as a current table at version 1."""
    return df.withColumn("lock_version", F.lit(1).cast("long")).withColumn("previous", F.lit(None).cast(PREVIOUS))


@dataclass
class Load:
    """A batch with its rejected rows and a report of one row: counters, invalid and broken rows, success and message."""

    applied: Upsert
    invalid: DataFrame
    report: DataFrame


def load(
    current: DataFrame, incoming: DataFrame, key: str, strategy: str, batch_id: str, batch_ts: Column, rules: Sequence[tuple[str, Column]] = (), keep_invalid: Column | None = None,
    pre_write: Callable[[DataFrame], DataFrame] | None = None, broken: DataFrame | None = None, **options: Any,
) -> Load:
    """Hook, validation, upsert and report in one. Rows that break a rule stay out unless ``keep_invalid`` says otherwise; rows without a key always do.

    ``broken`` holds texts that could not be read: the rest is applied, and the report says that the load failed.
    """
    rows = pre_write(incoming) if pre_write else incoming
    keyless = constraint(key, "not_null")
    marked = violations(rows, [keyless, *rules])
    keep = None if keep_invalid is None else keep_invalid & ~keyless[1]
    accepted, invalid = split_invalid(marked, "quarantine", keep)
    applied = upsert(current, accepted, key, strategy, batch_id, batch_ts, **options)
    bad = invalid.agg(F.count("*").alias("invalid"))
    unread = broken.agg(F.count("*").alias("broken")) if broken is not None else bad.sparkSession.range(1).select(F.lit(0).cast("long").alias("broken"))
    report = applied.metrics.crossJoin(bad).crossJoin(unread)  # one row each
    report = report.withColumn("success", F.col("broken") == 0).withColumn("message", F.when(F.col("broken") > 0, F.concat(F.col("broken").cast("string"), F.lit(" texts could not be read"))).otherwise(F.lit("")))
    return Load(applied, invalid, report)
