"""A kept index against full scans after changes, words with marks, documents of any depth and merged documents."""

import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctide.operators import find, quality, search
from doctide.sources import buckets

DOC = T.StructType().add("id", "long").add("text", "string")


def test_query_words_are_cut_as_texts_are(spark):
    docs = spark.createDataFrame([(1, "A blue-fox, quick"), (2, "red/dog")], DOC)
    for query in ("Blue-Fox", "fox_blue;", "blue,fox"):
        assert [r["id"] for r in search.text_search(docs, "id", ["text"], query).collect()] == [1]
    assert search.text_search(docs, "id", ["text"], " -- ").collect() == []


def test_kept_index_equals_a_full_scan_after_each_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "FAN", 3)
    rng, words = random.Random(4), [f"w{i}" for i in range(30)] + ["the"] * 10
    index = search.KeptIndex(spark, f"file://{tmp_path}", "id", ["text"], DOC, n_buckets=16, spread=2)
    now = {}
    for batch in range(8):
        before = {i: now[i] for i in rng.sample(sorted(now), min(len(now), 6))}
        after = {i: " ".join(rng.choices(words, k=rng.randint(0, 9))) for i in [*[i for i in before if rng.random() < 0.6], *range(batch * 10, batch * 10 + 5)]}
        for i in before:
            now.pop(i)
        now |= after
        sides = [spark.createDataFrame(list(d.items()), DOC) for d in (before, after)]
        index.bring_forward(*sides, batch)
        index.bring_forward(*sides, batch)  # a repeated batch
        docs = spark.createDataFrame(list(now.items()), DOC)
        for query in ("w1 the", "W2-w3"):
            key = lambda rows: sorted((r["id"], round(r["score"], 5)) for r in rows)
            assert key(index.search(query, None).collect()) == key(search.text_search(docs, "id", ["text"], query).collect())
    # Only the folders of the asked terms' buckets are read.
    read = index.found("w1 w2").inputFiles()
    known = index.table.manifest()
    wanted = {r[0] for r in spark.createDataFrame([("w1",), ("w2",)], "t string").select(buckets.bucket_of(F.col("t"), 16)).collect()}
    assert read and {int(f.split("__bucket=")[1].split("/")[0]) for f in read} <= wanted and len(known.history) <= 6
    assert index.search("absent", None).collect() == [] and index.search("", None).collect() == []


def test_a_batch_of_the_kept_index_cuts_texts_once_and_deals_its_rows_out_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "FAN", 2)
    index, plans = search.KeptIndex(spark, f"file://{tmp_path}", "id", ["text"], DOC, n_buckets=4, spread=2), []
    put = index._put
    monkeypatch.setattr(index, "_put", lambda rows, path: (plans.append((path, rows._jdf.queryExecution().executedPlan().toString())), put(rows, path)))
    old, new = [(1, "a b a"), (2, None), (3, " - "), (4, "b")], [(1, "a a a c"), (3, "b b"), (5, "")]
    sides = [spark.createDataFrame(rows, DOC).repartition(2).localCheckpoint() for rows in (old, new)]
    index.bring_forward(sides[0].limit(0), sides[0], 0)
    assert index.table.manifest().totals == {"rows": 4, "words": 4}
    index.bring_forward(*sides, 1)
    assert index.table.manifest().totals == {"rows": 3, "words": 6} and index.table.manifest().history == [(1, 1)]
    held = [(r["term"], r["id"], r["length"], r["tf"]) for r in index.found("a b c").collect()]
    assert sorted(held) == [("a", 1, 4, 3), ("b", 3, 2, 2), ("c", 1, 4, 1)]
    plan = next(text for path, text in plans if path.endswith("/0-1")).split("== Initial Plan ==")[0]
    assert "Exchange" not in plan and plan.count("split(") == 2  # once a side
    assert not any("=-1" in f for f in spark.read.parquet(f"file://{tmp_path}/history/1-1").inputFiles())  # documents' rows are no part of what is kept


def test_paths_through_arrays_of_objects(spark):
    rows = [(1, [(6, [1, 2]), (7, None)]), (2, [(5, [9])]), (3, None), (4, [None])]
    df = spark.createDataFrame(rows, "id long, lines array<struct<p:long,q:array<long>>>")
    for spec, want in [({"lines.p": 6}, [1]), ({"lines.p": {"$gt": 5}}, [1]), ({"lines.q": 2}, [1]), ({"lines.p": {"$in": [5, 7]}}, [1, 2]), ({"lines.p": {"$ne": 6}}, [2, 3, 4]), ({"lines.p": {"$size": 2}}, [1]), ({"lines.p": None}, [3])]:
        assert [r["id"] for r in find.find(df, {"filter": spec}).collect()] == want, spec


def test_stages_and_positional_projection(spark):
    rows = [(1, [(6, 1), (7, 2), (7, 3)]), (2, [(5, 9)]), (3, None)]
    df = spark.createDataFrame(rows, "id long, lines array<struct<p:long,q:long>>")
    out = find.find(df, {"filter": {"lines.p": {"$gte": 7}}, "projection": {"id": 1, "lines.$": 1}}).collect()
    assert [(r["id"], [tuple(x) for x in r["lines"]]) for r in out] == [(1, [(7, 2)])]
    out = find.find(df, {"filter": {"lines": {"$elemMatch": {"p": 7, "q": 3}}}, "projection": {"lines.$": 1}}, "id").collect()
    assert [(r["id"], [tuple(x) for x in r["lines"]]) for r in out] == [(1, [(7, 3)])]
    counted = find.find(df, {"filter": {"id": {"$lt": 3}}, "sort": {"n": -1}}, stages=[lambda d: d.select("id", F.size("lines").alias("n")), lambda d: d.filter("n > 0")])
    assert [tuple(r) for r in counted.collect()] == [(1, 3), (2, 1)]


def test_one_schema_for_all_documents(spark):
    raw = spark.createDataFrame([('{"a":1,"b":{"c":"x"}}',), ('{"a":2.5,"d":[true]}',)], "raw string")
    assert re.fullmatch(r"OBJECT<a: DECIMAL\(\d+,1\), b: OBJECT<c: STRING>, d: ARRAY<BOOLEAN>>", quality.infer_schema(raw, "raw"))


def test_leaves_of_any_depth(spark):
    deep = '{"a":' * 12 + '"7"' + "}" * 12
    rows = [(1, deep), (2, '{"l":[1,"2024-01-01",null],"o":[{"x":"1"},{"y":[{"z":[3]}]}],"e":{}}'), (3, "broken"), (4, None), (5, "[[1],[2]]")]
    out = quality.coerce_leaves(spark.createDataFrame(rows, "id long, raw string"), "raw").collect()
    told = sorted((r["id"], r["path"], r["number"]) for r in out if r["number"] is not None)
    assert told == [(1, ".".join("a" * 12), 7.0), (2, "l", 1.0), (2, "o.x", 1.0), (2, "o.y.z", 3.0), (5, "", 1.0), (5, "", 2.0)]
    assert {(r["path"], str(r["day"])) for r in out if r["day"]} == {("l", "2024-01-01")} and ("e", None) in {(r["path"], r["number"]) for r in out}


def test_merged_document_is_the_same_in_any_order(spark):
    texts = ['{"a":{"b":1},"l":["t"],"n":null,"s":" "}', '{"a":5,"l":[{"x":1},{"y":{"z":[]}}],"n":[],"s":"v"}', '{"a":{"c":"q"},"l":"word","s":"u"}', "broken"]
    seen = set()
    for order in (texts, texts[::-1], texts[1:] + texts[:1]):
        seen.add(quality.merge_documents(spark.createDataFrame([(t,) for t in order], "raw string").coalesce(1), "raw").first()["document"])
    assert seen == {'{"a":{"b":1,"c":"q"},"l":[{"x":1,"y":{"z":[]}}],"n":[],"s":"u"}'}
    assert quality.merge_documents(spark.createDataFrame([("broken",)], "raw string"), "raw").collect() == []
