"""The bucketed table: what a batch writes, repeats, failures, history in levels, and streams that hold rows back."""

import json
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctide.operators import history
from doctide.sources import buckets, readers
from doctide.streaming.upsert_stream import stream_upsert

DOC = T.StructType().add("id", "long").add("v", "long")


def frame(spark, pairs):
    return spark.createDataFrame(pairs, DOC)


def at(n):
    return F.timestamp_seconds(F.lit(n))


def files(root, folder):
    return {os.path.join(d, f) for d, _, names in os.walk(root / folder) for f in names if f.endswith(".parquet")}


def content(table):
    return {r["id"]: r["v"] for r in table.state().collect()}


def test_a_batch_rewrites_the_buckets_it_changes(spark, tmp_path):
    table = buckets.BucketTable(spark, f"file://{tmp_path}")
    apply = lambda rows, n, **more: buckets.apply_batch(table, frame(spark, rows), n, "id", DOC, "UPDATEWITHHISTORY", 50, at(n), **more)
    apply([(i, i) for i in range(500)], 0)
    before = files(tmp_path, "state")
    assert len(before) == 50 and content(table) == {i: i for i in range(500)}
    second = apply([(i, -i) for i in range(7, 70, 7)] + [(500, 500)], 1)
    made = files(tmp_path, "state") - before
    assert 0 < len(made) <= 10 and sum(b == 1 for b in second.written.values()) == len(made)
    assert content(table) == {i: -i if i in range(7, 70, 7) else i for i in range(501)}
    # The same rows again, as a new batch and as the same one: nothing is written but a manifest.
    now = files(tmp_path, "state") | files(tmp_path, "history")
    third = apply([(i, -i) for i in range(7, 70, 7)], 2)
    assert apply([(7, 12345)], 2) == third == table.manifest() and third.written == second.written
    assert files(tmp_path, "state") | files(tmp_path, "history") <= now
    assert third.totals == {"inserts": 501, "updates": 9, "deletes": 0, "conflicts": 0}
    # Only the buckets of asked keys are read.
    few = table.touched(third, F.col("id"), frame(spark, [(7, 0)]))
    assert len(few) == 1 and len(table.state(buckets=few).inputFiles()) == 1 and 7 in {r["id"] for r in table.state(buckets=few).collect()}
    # Folders that no kept manifest names are gone.
    assert {f for f in files(tmp_path, "state") if "batch=0" in f} == {f for f in before if str(50) and any(f"__bucket={b}/" in f for b, n in third.written.items() if n == 0)}
    was = history.as_of(table.state(), table.history(), "id", at(0))
    assert {r["id"]: r["v"] for r in was.collect()} == {i: i for i in range(500)}


def test_a_failed_batch_leaves_the_table_as_it_was(spark, tmp_path):
    table = buckets.BucketTable(spark, f"file://{tmp_path}")
    apply = lambda rows, n, **more: buckets.apply_batch(table, frame(spark, rows), n, "id", DOC, "REPLACE", 4, at(n), **more)
    apply([(1, 1), (2, 2)], 0)

    def fail(changes, number):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        apply([(1, 10), (3, 3)], 1, post_write=fail)
    assert content(table) == {1: 1, 2: 2} and table.history().count() == 2
    seen = []
    apply([(1, 10), (3, 3)], 1, post_write=lambda changes, number: seen.append((number, sorted(r["type"] for r in changes.collect()))))
    assert content(table) == {1: 10, 2: 2, 3: 3} and seen == [(1, ["insert", "update"])] and table.history().count() == 4


def test_deletes_empty_buckets_and_history_in_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "FAN", 3)
    table = buckets.BucketTable(spark, f"file://{tmp_path}")
    schema = T.StructType([*DOC.fields, T.StructField("gone", T.BooleanType())])
    for n in range(10):
        rows = spark.createDataFrame([(1, n, False), (2, n, n == 9)], schema)
        buckets.apply_batch(table, rows, n, "id", DOC, "UPDATEWITHHISTORY", 8, at(n), delete="gone")
    known = table.manifest()
    assert content(table) == {1: 9} and len(known.written) == 1 and known.history == [(2, 8), (0, 9)]
    assert table.history().count() == 20 and len(os.listdir(tmp_path / "history")) <= 5
    for n in range(10):
        was = history.as_of(table.state(), table.history(), "id", at(n), include_deleted=True).collect()
        assert {r["id"]: r["v"] for r in was} == ({1: n, 2: n} if n < 9 else {1: 9})
    assert len(os.listdir(tmp_path / "manifests")) <= 4 and not [n for n in os.listdir(tmp_path / "times")] if (tmp_path / "times").exists() else True


def drop(folder, name, rows, stamp):
    part = folder / f".{name}"
    part.write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    os.utime(part, (stamp, stamp))
    part.rename(folder / name)


def test_stream_holds_rows_back_until_there_are_enough_or_none_come(spark, tmp_path):
    source, seen = tmp_path / "in", []
    source.mkdir()
    rows = readers.stream_documents(spark, "text", DOC, path=str(source), maxFilesPerTrigger="1")
    made = stream_upsert(rows, f"file://{tmp_path}/table", DOC, "id", str(tmp_path / "check"), every="0 seconds", n_buckets=4, flush_rows=100, idle_seconds=4.0, post_write=lambda changes, n: seen.append(changes.count()))
    try:
        for k in range(9):
            drop(source, f"{k}.json", [{"id": k * 25 + i, "v": k} for i in range(25)] if k < 8 else [{"id": 1000 + i, "v": 0} for i in range(7)], 1000 + k)
        until = time.time() + 90
        while sum(seen) < 207 and time.time() < until and made.query.isActive:
            time.sleep(0.2)
    finally:
        made.drain()
    assert seen == [100, 100, 7] and made.state().count() == 207 and made.counters().first()["inserts"] == 207


def test_stream_goes_on_with_what_was_held_back(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = readers.stream_documents(spark, "text", DOC, path=str(source), maxFilesPerTrigger="1")
    start = lambda: stream_upsert(rows, f"file://{tmp_path}/table", DOC, "id", str(tmp_path / "check"), every=None, n_buckets=4, flush_rows=50, idle_seconds=600.0)
    drop(source, "0.json", [{"id": i, "v": 1} for i in range(10)] + [{"v": 3}], 1000)
    held = start()
    held.query.awaitTermination()  # as if the driver were lost here
    held.holder.timer.cancel()
    assert held.table.manifest() is None
    drop(source, "1.json", [{"id": i, "v": 2} for i in range(5, 15)], 1001)
    again = start()
    again.query.awaitTermination()
    kept = tmp_path / "kept"
    shutil.copytree(tmp_path / "table/pending", kept)
    again.finish()
    # As if the driver were lost between publication and clearing up: what is published isn't applied again.
    shutil.copytree(kept, tmp_path / "table/pending", dirs_exist_ok=True)
    again = start()
    again.finish()
    assert {r["id"]: r["v"] for r in again.state().collect()} == {i: 1 if i < 5 else 2 for i in range(15)}
    assert again.counters().first()["broken"] == 1 and not os.listdir(tmp_path / "table/pending")


def test_tables_are_made_before_a_load(spark, tmp_path):
    asked = {"a": (f"file://{tmp_path}/a", DOC, "id"), "b": (f"file://{tmp_path}/b", T.StructType().add("id", "long").add("w", "string"), "id")}
    with pytest.raises(ValueError, match="table a is missing"):
        buckets.ensure_tables(spark, asked, create=False)
    first = {r["name"]: r for r in buckets.ensure_tables(spark, asked, n_buckets=4).collect()}
    assert all(r["created"] and not r["present"] and r["batch"] == -1 for r in first.values())
    table = buckets.BucketTable(spark, asked["a"][0])
    assert table.state().count() == 0 and table.history().count() == 0
    buckets.apply_batch(table, frame(spark, [(1, 1)]), 0, "id", DOC, batch_ts=at(1))
    asked["b"] = (asked["a"][0], asked["b"][1], "id")
    again = {r["name"]: r for r in buckets.ensure_tables(spark, asked, create=False).collect()}
    assert again["a"]["present"] and again["a"]["batch"] == 0 and again["a"]["schema_diff"] == "" and again["b"]["schema_diff"] == "w:missing"


def test_relational_source_in_key_ranges(spark):
    url, rows = "jdbc:derby:memory:doctide;create=true", [(i, f"n{i}") for i in range(100)]
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.createDataFrame(rows, "id long, name string").write.format("jdbc").options(url=url, dbtable="people", **options).mode("overwrite").save()
    read = readers.read_jdbc(spark, url, 'SELECT * FROM people WHERE "id" < 90', "id", 0, 90, 3, **options)
    assert read.rdd.getNumPartitions() == 3 and sorted(r[0] for r in read.collect()) == list(range(90))
