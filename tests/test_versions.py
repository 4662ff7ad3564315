"""Batches with repeated keys, deletes and re-insertions against a serial replay, and states at every instant."""

import copy
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctide.operators import history, upsert

DOC = (
    T.StructType().add("id", "long").add("name", "string").add("place", T.StructType().add("town", "string").add("zip", "long"))
    .add("tags", T.ArrayType(T.StringType())).add("parts", T.ArrayType(T.StructType().add("k", "long").add("t", "string")))
)
BATCH = T.StructType([*DOC.fields, T.StructField("gone", T.BooleanType()), T.StructField("n", T.LongType())])


def at(hour):
    return F.to_timestamp(F.lit(f"2024-01-01 {hour:02d}:00:00"))


def saved(df):
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def one(rng, i, n):
    pick = lambda *options: rng.choice([None, *options])
    place = rng.choice([None, (pick("x", "y"), pick(1, 2)), (pick("x"), 3)])
    tags = rng.choice([None, [], ["a"], ["a", None], ["b", "a", "c"], ["a", "b", "c", "d"]])
    parts = rng.choice([None, [(1, "p")], [(1, None), (2, "q")], [(2, "q"), None]])
    return (i, pick("A", "B"), place, tags, parts, rng.choice([None, False, False, True]), n)


def plain(row):
    """A document without the marker; an object of nulls is null."""
    i, name, place, tags, parts = row[:5]
    return [i, name, None if place is None or tuple(place) == (None, None) else tuple(place), tags, parts and [p and tuple(p) for p in parts]]


def replay(state, rows, strategy):
    for row in rows:
        new = plain(row)
        if row[5]:
            state.pop(row[0], None)
        elif strategy == "REPLACE" or row[0] not in state:
            state[row[0]] = new
        else:
            old = state[row[0]]
            place = [(n if n is not None else o) for o, n in zip(old[2] or (None, None), new[2] or (None, None), strict=True)]
            merged = [n if n is not None else o for o, n in zip(old, new, strict=True)]
            merged[2] = None if place == [None, None] else tuple(place)
            state[row[0]] = merged


def documents(df):
    return sorted((plain(r) for r in df.select(*DOC.names).collect()), key=repr)


@pytest.mark.parametrize("strategy", ["REPLACE", "UPDATEWITHHISTORY"])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches_equal_a_serial_replay(spark, strategy, seed):
    rng, expected, seen, log = random.Random(seed), {}, [], None
    state = upsert.with_bookkeeping(spark.createDataFrame([], DOC))
    for hour in range(1, 6):
        rows = [one(rng, rng.randrange(12), n) for n in range(24)]
        replay(expected, rows, strategy)
        seen.append(copy.deepcopy(expected))
        rng.shuffle(rows)
        made = upsert.upsert(state, spark.createDataFrame(rows, BATCH), "id", strategy, f"b{hour}", at(hour), "gone", "n")
        state, changes = saved(made.state), saved(history.history_rows(made.changes, hour))
        log = changes if log is None else log.unionByName(changes)
        assert documents(state) == sorted(expected.values(), key=repr)
    for hour, was in enumerate(seen, 1):
        assert documents(history.as_of(state, log, "id", at(hour), include_deleted=True)) == sorted(was.values(), key=repr)
        later = {r["record_id"] for r in log.filter((F.col("ts") > at(hour)) & (F.col("type") == "delete")).collect()}
        alive = [d for i, d in was.items() if i not in later]
        assert documents(history.as_of(state, log, "id", at(hour))) == sorted(alive, key=repr)
    assert documents(history.as_of(state, log, "id", at(0), include_deleted=True)) == []


def test_ties_of_the_order_go_by_content(spark):
    rows = [(1, "a", False, 5), (1, "b", False, 5), (2, "x", False, 1), (2, "x", False, 1)]
    for strategy in ("REPLACE", "UPDATE"):
        told = set()
        for order in (rows, rows[::-1]):
            out = upsert.collapse(spark.createDataFrame(order, "id long, v string, gone boolean, n long").coalesce(1), "id", "n", strategy, "gone").select("id", "v").collect()
            told.add(tuple(sorted(map(tuple, out))))
        assert len(told) == 1


def test_deleted_and_inserted_again_in_one_batch(spark):
    start = upsert.with_bookkeeping(spark.createDataFrame([(1, "old", ("x", 1), ["t"], None)], DOC))
    batch = spark.createDataFrame([(1, None, None, None, None, True, 1), (1, "new", None, None, None, None, 2)], BATCH)
    made = upsert.upsert(start, batch, "id", "UPDATEWITHHISTORY", "b", at(2), "gone", "n")
    assert documents(made.state) == [[1, "new", None, None, None]] and made.state.first()["lock_version"] == 1
    back = history.as_of(saved(made.state), saved(history.history_rows(made.changes)), "id", at(1))
    assert documents(back) == [[1, "old", ("x", 1), ["t"], None]]


def test_history_of_a_long_array_holds_what_changed(spark):
    kind = "id long, v array<long>"
    start = upsert.with_bookkeeping(spark.createDataFrame([(1, list(range(1000)))], kind))
    changed = list(range(1000))
    changed[700] = -1
    made = upsert.upsert(start, spark.createDataFrame([(1, changed)], kind), "id", "UPDATEWITHHISTORY", "b", at(2))
    assert made.changes.first()["changes"] == {"v": '{"n":1000}', "v[700]": '{"v":700}'}
    assert history.as_of(made.state, history.history_rows(made.changes), "id", at(1)).first()["v"] == list(range(1000))


def test_rows_without_a_key(spark):
    start = upsert.with_bookkeeping(spark.createDataFrame([(1, "a")], "id long, v string"))
    batch = spark.createDataFrame([(None, "x"), (None, "y"), (2, "b")], "id long, v string")
    with pytest.raises(Exception, match="a row has no id"):
        upsert.upsert(start, batch, "id", "UPDATE", "b", at(1)).state.collect()
    loaded = upsert.load(start, batch, "id", "UPDATE", "b", at(1))
    assert loaded.report.first()["invalid"] == 2 and sorted(r["id"] for r in loaded.applied.state.collect()) == [1, 2]


def test_insert_that_fails_on_known_keys(spark):
    start = upsert.with_bookkeeping(spark.createDataFrame([(1, "a")], "id long, v string"))
    batch = spark.createDataFrame([(1, "x"), (2, "b")], "id long, v string")
    reported = upsert.upsert(start, batch, "id", "INSERT", "b", at(1))
    assert reported.metrics.first()["conflicts"] == 1 and {(r["id"], r["v"]) for r in reported.state.collect()} == {(1, "a"), (2, "b")}
    with pytest.raises(Exception, match="key exists: 1"):
        upsert.upsert(start, batch, "id", "INSERT", "b", at(1), conflicts="fail").state.collect()
