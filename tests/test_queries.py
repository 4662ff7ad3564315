"""Every registered query with SQL against DuckDB, and the upsert, history, source and stream operators on fixtures."""

import json
import os
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctide.operators import find, history, quality, upsert
from doctide.plans import registry
from doctide.sources import readers, sinks
from doctide.streaming.upsert_stream import stream_upsert

SF = "/root/testdata/sf0.001"
TABLES = [f.removesuffix(".parquet") for f in os.listdir(SF)] if os.path.isdir(SF) else []


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    return None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else round(float(v), 6) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    cols = sorted(ours.columns)
    key = lambda df: sorted(repr([plain(v) for v in r]) for r in df[cols].astype(object).itertuples(index=False))
    assert key(ours) == key(theirs)


def test_array_delta_spans_whole_texts(spark, monkeypatch):
    """With the rebuilt array replaced by its unchanged elements, the query's n counts those: most words of any text."""
    monkeypatch.setattr(history, "apply_array_delta", lambda new, delta: F.transform(F.filter(delta, lambda d: d["same"]), lambda d: F.lit("same")))
    same = {r["doc_id"]: r["n"] for r in registry.QUERIES["array_delta_roundtrip"](spark, SF).collect()}
    words = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.size(F.split("text", " ")).alias("n")).filter("n > 80").collect()
    assert words and all(0.7 * r["n"] < same[r["doc_id"]] < r["n"] for r in words)


DOC = (
    T.StructType().add("testid", "long").add("testresult", "string").add("testmileage", "long")
    .add("vehicle", T.StructType().add("make", "string").add("model", "string")).add("items", T.ArrayType(T.StringType()))
)


def docs(spark, *rows):
    return readers.bind(spark.createDataFrame([(json.dumps(r),) for r in rows], "raw string"), DOC, payload=None)


def at(hour):
    return F.to_timestamp(F.lit(f"2024-01-01 {hour:02d}:00:00"))


def run(spark, state, hour, strategy, *rows, **more):
    return upsert.upsert(state, docs(spark, *rows), "testid", strategy, f"b{hour}", at(hour), **more)


def start(spark):
    return upsert.with_bookkeeping(spark.createDataFrame([], DOC))


def as_rows(df):
    return sorted(df.select("testid", F.to_json(F.struct("testresult", "testmileage", "vehicle", "items")).alias("j")).collect())


def test_as_of_returns_every_version(spark):
    versions = [
        {"testid": 1, "vehicle": {"make": "Ford", "model": "Focus"}, "items": ["Handbrake", "Lights", "Wipers"]},
        {"testid": 1, "vehicle": {"make": "Ford", "model": "Fiesta"}, "items": ["Brakes", "Lights"]},
        {"testid": 1, "testmileage": 5, "items": ["a", "b", "c", "d"]},
    ]
    state, log, seen = start(spark), None, []
    for hour, v in enumerate(versions, 1):
        made = run(spark, state, hour, "UPDATEWITHHISTORY", v)
        state = spark.createDataFrame(made.state.collect(), made.state.schema)
        rows = history.history_rows(made.changes, hour)
        log = rows if log is None else log.unionByName(rows)
        seen.append(as_rows(state))
    log = spark.createDataFrame(log.collect(), log.schema)
    for hour, want in enumerate(seen, 1):
        assert as_rows(history.as_of(state, log, "testid", at(hour))) == want
    assert history.as_of(state, log, "testid", at(0)).count() == 0
    assert state.first()["lock_version"] == 3 and history.change_log(log, 1).count() == 3


def test_reload_changes_nothing(spark):
    row = {"testid": 7, "vehicle": {"make": "Toyota", "model": "Corolla"}, "items": []}
    state = run(spark, start(spark), 1, "UPDATE", row).state
    again = run(spark, state, 2, "UPDATE", row)
    assert again.metrics.first()[:3] == (0, 0, 0) and again.state.collect() == state.collect()
    replaced = run(spark, run(spark, start(spark), 1, "REPLACE", row).state, 2, "REPLACE", row)
    assert replaced.metrics.first()[:3] == (0, 0, 0)


def test_delete_flag_and_last_of_a_batch(spark):
    schema = T.StructType([*DOC.fields, T.StructField("deleted", T.BooleanType()), T.StructField("n", T.IntegerType())])
    state = run(spark, start(spark), 1, "REPLACE", {"testid": 1}, {"testid": 2}).state
    batch = spark.createDataFrame([(1, None, None, None, None, True, 1), (2, "Passed", None, None, None, False, 1), (2, "Failed", None, None, None, None, 2)], schema)
    made = upsert.upsert(state, batch, "testid", "REPLACE", "b", at(2), "deleted", "n")
    assert [(r["testid"], r["testresult"]) for r in made.state.collect()] == [(2, "Failed")] and made.metrics.first()["deletes"] == 1
    kept = upsert.upsert(state, batch.filter("n = 1"), "testid", "REPLACE", "b", at(2), "deleted", "n", delete_when="present")
    assert kept.state.count() == 0


def test_unknown_operator_and_bad_text(spark):
    df = docs(spark, {"testid": 1})
    with pytest.raises(ValueError, match="invalid_operator"):
        find.find(df, {"filter": {"$invalid_operator": 1}})
    with pytest.raises(ValueError):
        find.find(df, "{not json")
    with pytest.raises(ValueError):
        find.find(df, {"projection": {"testid": 1, "items": 0}})


def test_nested_paths_and_arrays(spark):
    df = docs(spark, {"testid": 1, "vehicle": {"make": "Ford", "model": "Focus"}, "items": ["x", "y"]}, {"testid": 2})
    assert find.find(df, {"filter": {"vehicle.make": "Ford", "items": "y"}}).count() == 1
    assert find.find(df, {"filter": {"vehicle": None}}).first()["testid"] == 2
    assert find.keep_paths(df, "vehicle.model,items").first().asDict(True) == {"vehicle": {"model": "Focus"}, "items": ["x", "y"]}
    assert find.grid_view(df, {"i": "items", "f": "items.$"}).first()[:] == ("x,y", "x")


@pytest.mark.parametrize("layout", ["lines", "array", "concatenated"])
def test_layouts_give_the_same_documents(spark, tmp_path, layout):
    rows = [{"testid": i, "vehicle": {"make": "a{b"}, "extra": [i]} for i in range(3)]
    text = {"lines": "\n".join(map(json.dumps, rows)), "array": json.dumps(rows, indent=1), "concatenated": "".join(map(json.dumps, rows))}[layout]
    (tmp_path / "f.json").write_text(text)
    good, bad = readers.read_documents(spark, str(tmp_path / "f.json"), DOC, layout)
    assert [tuple(r) for r in good.orderBy("testid").select("testid", F.to_json("payload")).collect()] == [(i, f'{{"extra":[{i}]}}') for i in range(3)] and bad.count() == 0


def test_malformed_is_quarantined(spark, tmp_path):
    (tmp_path / "f.json").write_text('[{"testid": 1}, {"testid": 2 /* cut */')
    good, bad = readers.read_documents(spark, str(tmp_path / "f.json"), DOC, "array")
    assert good.count() == 1 and bad.count() == 1


def test_json_lines_splice_payload(spark):
    doc = {"testid": 1, "fuel": "p", "n": [1], "zip": "123", "flag": "true", "s": "null", "t": True, "none": None, "one": 1, "in": {"x": ["1", None, 2.5]}}
    df = readers.bind(spark.createDataFrame([(json.dumps(doc),), ('{"testid": 2}',), ('{"x": {}}',)], "raw string"), DOC)
    assert [json.loads(r[0]) for r in sinks.json_lines(df, "payload").collect()] == [doc, {"testid": 2}, {"x": {}}]


def test_preflight(spark):
    df = docs(spark, {"testid": 1, "testmileage": 0}, {"testid": 1, "testmileage": 3})
    report = {r["name"]: r for r in quality.preflight(spark, {"a": (df, DOC, "testid", [quality.constraint("testmileage", "min", 1)]), "b": (None, DOC, "testid", [])}).collect()}
    assert (report["a"]["rows"], report["a"]["repeated_keys"], report["a"]["broken_rows"], report["b"]["present"]) == (2, 1, 1, False)


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"testid": i, "testmileage": k}) for i in range(k, k + 5)) + "\n{broken\n")
        os.utime(source / f"{k}.json", (1000 + k, 1000 + k))
    root = f"file://{tmp_path}/table"
    rows = readers.stream_documents(spark, "text", DOC, path=str(source), maxFilesPerTrigger="1")
    made = stream_upsert(rows, root, DOC, "testid", str(tmp_path / "check"), every=None)
    made.finish()
    assert {r["testid"]: r["testmileage"] for r in made.state().collect()} == {**dict.fromkeys(range(5), 0), **dict.fromkeys(range(1, 6), 1), **dict.fromkeys(range(2, 7), 2)}
    assert spark.read.parquet(f"{root}/quarantine").count() == 3 and made.counters().first()["broken"] == 3


def test_documents_are_not_broadcast_by_guessed_sizes(spark):
    """a table's share without its payload of variants looks hundreds of times smaller than it is."""
    made = registry.QUERIES["typed_payload"](spark, SF)
    said = made._jdf.queryExecution().sparkPlan().toString()
    assert re.findall(r"(\w+Join) ", said)[:2] == ["SortMergeJoin", "SortMergeJoin"]


def test_later_messages_of_equal_values_are_changes(spark, tmp_path):
    """a user whose last events of two batches have equal type and value."""
    rows = [(n, n % 2, "click" if n < 12 else "view", 1.5) for n in range(16)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    wanted = sorted(con.execute(registry.ORACLE_SQL["stream_history"]).fetchall())
    got = registry.QUERIES["stream_history"](spark, str(tmp_path)).select("batch", "type", "n").collect()
    assert sorted(map(tuple, got)) == sorted((b, t, n) for b, t, n in wanted) and (1, "update", 2) in wanted


def test_generated_documents_are_not_shuffled_to_a_small_table(spark):
    """weights learned from many rows make a small table, which goes to the documents."""
    from doctide.operators import generate

    table = spark.range(100000).groupBy((F.col("id") % 2).cast("string").alias("v")).agg(F.count("*").alias("probability"))
    made = generate.generate(spark, 100, {"t": table})
    said = made._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in said and "SortMergeJoin" not in said
    assert "RLIKE" not in said  # values are told for the table's rows, before
    assert {r[0] for r in made.select("document").distinct().collect()} == {'{"v":0}', '{"v":1}'}
