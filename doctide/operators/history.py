"""Change history and state at a past instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .upsert import rebuild


def history_rows(changes: DataFrame, first_seq: int = 0) -> DataFrame:
    """Rows for an append-only history table; inserts carry no content. ``seq`` breaks ties between batches of one instant."""
    name = F.sha2(F.concat_ws(":", "update_id", F.col("record_id").cast("string"), "type"), 256)
    content = F.when(F.col("type") != "insert", F.col("changes"))
    return changes.filter("type <> 'conflict'").select(name.alias("history_id"), "record_id", "ts", F.lit(first_seq).cast("long").alias("seq"), "type", content.alias("changes"))


def _restored(path: str, kind: T.DataType, now: Column) -> Column:
    """A path's value at the instant: as its earliest later change has it, else as it is. Arrays get their old length and old elements."""
    old = F.col("__back")[path]
    touched = F.coalesce(F.map_contains_key("__back", F.lit(path)), F.lit(False))
    if not isinstance(kind, T.ArrayType):
        return F.when(touched, F.from_json(old, T.StructType([T.StructField("v", kind)]))["v"]).otherwise(now)
    note = F.from_json(old, T.StructType([T.StructField("v", kind), T.StructField("n", T.IntegerType())]))
    element = T.StructType([T.StructField("v", kind.elementType)])

    def at(i: Column) -> Column:
        name = F.concat(F.lit(path + "["), i.cast("string"), F.lit("]"))
        return F.when(F.map_contains_key("__back", name), F.from_json(F.element_at("__back", name), element)["v"]).otherwise(F.get(now, i))

    places = F.when(note["n"] > 0, F.sequence(F.lit(0), note["n"] - 1)).when(note["n"] == 0, F.array().cast("array<int>"))
    return F.when(touched, F.coalesce(note["v"], F.transform(places, at))).otherwise(now)


def as_of(current: DataFrame, history: DataFrame, key: str, instant: Column, where: Column | None = None, include_deleted: bool = False) -> DataFrame:
    """Rows as they were at an instant: for every path, and every element of an array, the old value of the earliest later change.

    A key has a life from an insert to a delete. The first later one of these tells which life held the instant: an
    insert, none (no row); a delete, the life that it ended, whose last row the delete holds (a row only with
    ``include_deleted``); neither, the present one. Only changes of that life are undone. Events of one key are told
    apart by ``ts`` and ``seq``. ``where`` tests the current version, so it also leaves out keys that have none.
    """
    later = history.filter(F.col("ts") > instant)
    doc = T.StructType([f for f in current.schema if f.name not in ("lock_version", "previous")])
    base = current.select(*[f.name for f in doc])
    if where is not None:
        base = base.filter(where)
    place = F.struct("ts", "seq")
    bounds = later.filter("type IN ('insert', 'delete')").groupBy("record_id").agg(F.min_by(F.struct("type", place.alias("at"), "changes"), place).alias("__end"))
    present = base.join(bounds.select("record_id"), F.col(key) == F.col("record_id"), "left_anti")
    if include_deleted:
        ended = bounds.filter("__end.type = 'delete'").select("record_id", F.col("__end.changes").alias("__was"))
        if where is not None:
            ended = ended.join(base.select(F.col(key).alias("record_id")), "record_id", "left_semi")
        leaf = lambda p, k: (F.from_json(F.col("__was")[p], T.StructType([T.StructField("v", k)]))["v"] if p != key else F.col("record_id"))
        present = present.unionByName(ended.select(*rebuild(doc, leaf)))
    updates = later.filter("type = 'update'").join(bounds.select("record_id", F.col("__end.at").alias("__until")), "record_id", "left")
    updates = updates.filter(F.col("__until").isNull() | (place < F.col("__until")))
    first = updates.select("record_id", "ts", "seq", F.explode("changes").alias("path", "old")).groupBy("record_id", "path").agg(F.min_by(F.struct("old"), place).alias("o"))
    back = first.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("path", F.col("o.old")))).alias("__back"))  # at most the document's paths
    rows = present.join(back, F.col(key) == F.col("record_id"), "left").drop("record_id")
    return rows.select(*rebuild(doc, lambda path, kind: F.col(path) if path == key else _restored(path, kind, F.col(path))))


def change_log(history: DataFrame, record_id) -> DataFrame:
    """The events of one key, newest first."""
    return history.filter(F.col("record_id") == F.lit(record_id)).orderBy(F.desc("ts"), F.desc("seq"))


def as_of_one(current: DataFrame, history: DataFrame, key: str, value, instant: Column) -> DataFrame:
    """One key at an instant; its own history is all that is read."""
    return as_of(current.filter(F.col(key) == F.lit(value)), history.filter(F.col("record_id") == F.lit(value)), key, instant)


def array_delta(old: Column, new: Column) -> Column:
    """Per index whether the element is the same, and the old element where it isn't; with the old length."""
    return F.transform(old, lambda o, i: F.struct(o.eqNullSafe(F.get(new, i)).alias("same"), F.when(~o.eqNullSafe(F.get(new, i)), o).alias("old")))


def apply_array_delta(new: Column, delta: Column) -> Column:
    """The old array: of its own length, elements marked the same taken from the new one."""
    return F.transform(delta, lambda d, i: F.when(d["same"], F.get(new, i)).otherwise(d["old"]))
