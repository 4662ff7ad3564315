"""Registered queries over the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import alias, find, generate, history, joins, profile, quality, querylog, search, upsert
from ..sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def find_filter_sort_page(spark, sf_dir):
    spec = {"filter": {"o_orderstatus": "F", "o_totalprice": {"$gt": 1e5}}, "projection": {"o_totalprice": 1, "o_orderdate": 1}, "sort": {"o_totalprice": -1}, "skip": 5, "limit": 20}
    return find.find(_table(spark, sf_dir, "orders"), spec, "o_orderkey")


@_query("""SELECT o_orderkey FROM orders WHERE (o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_totalprice <= 50000) AND NOT (o_orderstatus = 'O')
AND regexp_matches(o_orderpriority, '^[1-3]') AND o_custkey IS NOT NULL AND o_orderstatus NOT IN ('P')""")
def find_logical(spark, sf_dir):
    spec = {"filter": {"$or": [{"o_orderpriority": {"$in": ["1-URGENT", "2-HIGH"]}}, {"o_totalprice": {"$lte": 50000}}], "$nor": [{"o_orderstatus": "O"}], "o_orderpriority": {"$regex": "^[1-3]"}, "o_custkey": {"$exists": True}, "o_orderstatus": {"$nin": ["P"]}}, "projection": {"o_orderkey": 1}, "limit": 0}
    return find.find(_table(spark, sf_dir, "orders"), spec)


@_query("SELECT * FROM part WHERE p_brand = 'Brand#12' AND p_size = 10")
def query_by_example(spark, sf_dir):
    return find.by_example(_table(spark, sf_dir, "part"), {"p_brand": "Brand#12", "p_size": 10, "p_name": None})


@_query("SELECT p_partkey, p_name FROM part WHERE p_size > 20 ORDER BY p_partkey LIMIT 10 OFFSET 20")
def page_by_size(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").filter("p_size > 20").select("p_partkey", "p_name")
    return find.page(rows, 2, 10, "p_partkey")


@_query("SELECT avg(l_extendedprice) AS average FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL HAVING count(*) > 0")
def avg_no_row_on_empty(spark, sf_dir):
    return profile.average(_table(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "R", "l_extendedprice")


@_query("SELECT event_type AS value, count(*) AS probability FROM events GROUP BY 1")
def freq_field(spark, sf_dir):
    return profile.frequency(_table(spark, sf_dir, "events"), "event_type")


@_query("SELECT value, count(*) AS probability FROM (SELECT unnest(string_split(text, ' ')) AS value FROM documents) GROUP BY 1")
def freq_unnest(spark, sf_dir):
    return profile.frequency_exploded(_table(spark, sf_dir, "documents"), F.split("text", " "))


@_query("""SELECT o_orderstatus, coalesce(n, 0) AS n_lines, count(*) AS probability FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def freq_composite(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("lines"))
    both = _table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return profile.frequency_composite(both, "o_orderstatus", "lines", "n_lines")


@_query("""SELECT o_orderkey, count(l_orderkey) AS n, coalesce(sum(l_linenumber), 0)::BIGINT AS total, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS parts
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def nest_children(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    nested = joins.nest_lookup(_table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", "l_orderkey", "lines", [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")])
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["l_linenumber"])
    return nested.select("o_orderkey", F.size("lines").cast("long").alias("n"), total.alias("total"), F.array_join(F.transform("lines", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@_query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def code_lookup_chain(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation")
    rows = joins.code_lookup(_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), nation, "c_nationkey", "n_nationkey", "n_name", "n_name")
    rows = joins.code_lookup(rows, nation, "c_nationkey", "n_nationkey", "n_regionkey", "n_regionkey")
    return joins.code_lookup(rows, _table(spark, sf_dir, "region"), "n_regionkey", "r_regionkey", "r_name", "r_name").select("c_custkey", "n_name", "r_name")


@_query("""WITH t AS (SELECT DISTINCT p_size AS id, p_size // 2 AS up, 'size ' || p_size AS name FROM part)
SELECT p_partkey, a.name AS name_1, b.name AS name_2, c.name AS name_3, d.name AS name_4 FROM part LEFT JOIN t a ON a.id = p_size AND a.id <> 0 LEFT JOIN t b ON b.id = a.up AND b.id <> 0 LEFT JOIN t c ON c.id = b.up AND c.id <> 0 LEFT JOIN t d ON d.id = c.up AND d.id <> 0""")
def parent_chain(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_size")
    tree = part.select(F.col("p_size").alias("id"), F.floor(F.col("p_size") / 2).cast("int").alias("up"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("name")).distinct()
    return joins.parent_chain(part, tree, "p_size", "id", "up", "name").drop("p_size")


@_query("SELECT c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier WHERE s_acctbal > 0")
def union_with(spark, sf_dir):
    left = _table(spark, sf_dir, "customer").selectExpr("c_name AS name", "c_acctbal AS acctbal", "c_mktsegment AS segment")
    return joins.union_with(left, _table(spark, sf_dir, "supplier").filter("s_acctbal > 0").selectExpr("s_name AS name", "s_acctbal AS acctbal"))


_LATEST = "l_shipdate DESC, l_extendedprice DESC, l_partkey, l_suppkey, l_quantity, l_discount, l_tax"


@_query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LATEST}) AS n FROM lineitem) WHERE n = 1")
def dedupe_latest(spark, sf_dir):
    order = [F.col(x.split()[0]).desc() if "DESC" in x else F.col(x) for x in _LATEST.split(", ")]
    return joins.first_per_key(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


_TS = "2024-06-01 00:00:00"


def _batch(spark, sf_dir, strategy: str) -> upsert.Upsert:
    """Base: orders but every tenth. Incoming: a price of every seventh raised, the status of every fifth nulled, every eleventh deleted."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    base = upsert.with_bookkeeping(orders.filter("o_orderkey % 10 <> 0"))
    incoming = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")))
    incoming = incoming.withColumn("deleted", F.when(F.col("o_orderkey") % 11 == 0, F.lit(True)))
    return upsert.upsert(base, incoming, "o_orderkey", strategy, "batch-1", F.to_timestamp(F.lit(_TS)), "deleted")


_IN = """i AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS s, o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS p, o_orderpriority AS q, o_orderkey % 11 = 0 AS d FROM orders),
c AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p, o_orderpriority AS q FROM orders WHERE o_orderkey % 10 <> 0)"""
_STATE = "SELECT k AS o_orderkey, {s} AS o_orderstatus, i.p AS o_totalprice, i.q AS o_orderpriority, {v}::BIGINT AS lock_version FROM i LEFT JOIN c USING (k) WHERE NOT i.d"


def _state(made: upsert.Upsert) -> DataFrame:
    return made.state.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "lock_version")


@_query(f"WITH {_IN} " + _STATE.format(s="i.s", v="1"))
def upsert_replace(spark, sf_dir):
    return _state(_batch(spark, sf_dir, "REPLACE"))


_PATCHED = f"WITH {_IN} " + _STATE.format(s="coalesce(i.s, c.s)", v="CASE WHEN c.k IS NULL THEN 1 WHEN i.p <> c.p THEN 2 ELSE 1 END")


@_query(_PATCHED)
def upsert_update(spark, sf_dir):
    return _state(_batch(spark, sf_dir, "UPDATE"))


@_query(f"WITH {_IN} SELECT k AS o_orderkey, CASE WHEN c.k IS NOT NULL AND i.p <> c.p THEN 'o_totalprice' END AS changed, CASE WHEN c.k IS NULL OR i.p <> c.p THEN '{_TS}' END AS at FROM i LEFT JOIN c USING (k) WHERE NOT i.d")
def upsert_history(spark, sf_dir):
    made = _batch(spark, sf_dir, "UPDATEWITHHISTORY")
    return made.state.select("o_orderkey", F.array_join(F.map_keys("previous.changes"), ",").alias("changed"), F.date_format("previous.last_update", "yyyy-MM-dd HH:mm:ss").alias("at"))


@_query("SELECT o_orderkey AS record_id FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 11 = 0")
def upsert_delete(spark, sf_dir):
    return _batch(spark, sf_dir, "UPDATE").changes.filter("type = 'delete'").select("record_id")


@_query("SELECT o_orderkey AS record_id FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 11 <> 0")
def upsert_insert_conflicts(spark, sf_dir):
    return _batch(spark, sf_dir, "INSERT").changes.filter("type = 'conflict'").select("record_id")


@_query(f"WITH {_IN} SELECT count(*) FILTER (WHERE c.k IS NULL AND NOT d) AS inserts, count(*) FILTER (WHERE c.k IS NOT NULL AND NOT d AND i.p <> c.p) AS updates, count(*) FILTER (WHERE c.k IS NOT NULL AND d) AS deletes, 0::BIGINT AS conflicts FROM i LEFT JOIN c USING (k)")
def load_metrics(spark, sf_dir):
    return _batch(spark, sf_dir, "UPDATEWITHHISTORY").metrics


@_query(f"""WITH {_IN} SELECT k AS record_id, 'update' AS type, 'o_totalprice' AS path, round(c.p, 2) AS old FROM i JOIN c USING (k) WHERE NOT d AND i.p <> c.p
UNION ALL SELECT k, 'delete', 'o_totalprice', round(c.p, 2) FROM i JOIN c USING (k) WHERE d""")
def history_rows(spark, sf_dir):
    rows = history.history_rows(_batch(spark, sf_dir, "UPDATEWITHHISTORY").changes)
    return rows.select("record_id", "type", F.explode("changes").alias("path", "old")).filter("path = 'o_totalprice'").select("record_id", "type", "path", F.round(F.get_json_object("old", "$.v").cast("double"), 2).alias("old"))


@_query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY 1""")
def as_of_state(spark, sf_dir):
    """A user's events in time order are versions of one document: the newest is current, the others are reverse deltas."""
    events = _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "ts", "event_id", "event_type", "value")
    window = F.lead(F.struct("ts", "event_id")).over
    from pyspark.sql import Window

    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    stepped = events.withColumn("next", window(by_user)).withColumn("first", F.row_number().over(by_user) == 1)
    current = stepped.filter("next IS NULL").select("user_id", "event_type", "value")
    old = lambda c: F.to_json(F.struct(F.col(c).alias("v")))
    deltas = stepped.filter("next IS NOT NULL").select(F.col("user_id").alias("record_id"), F.col("next.ts").alias("ts"), F.col("next.event_id").alias("seq"), F.lit("update").alias("type"), F.create_map(F.lit("event_type"), old("event_type"), F.lit("value"), old("value")).alias("changes"))
    born = stepped.filter("first").select(F.col("user_id").alias("record_id"), "ts", F.col("event_id").alias("seq"), F.lit("insert").alias("type"), F.lit(None).cast("map<string,string>").alias("changes"))
    return history.as_of(current, deltas.unionByName(born), "user_id", F.to_timestamp(F.lit("2024-01-15")))


@_query("SELECT doc_id, len(string_split(text, ' ')) AS n, true AS same FROM documents")
def array_delta_roundtrip(spark, sf_dir):
    """Every seventh word is replaced; by the id, a word is appended, five are cut at the end, or neither."""
    words = _table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("old"))
    edited = words.withColumn("edited", F.transform("old", lambda w, i: F.when(i % 7 == 3, F.concat(w, F.lit("*"))).otherwise(w)))
    longer, shorter = F.concat("edited", F.array(F.lit("added"))), F.slice("edited", F.lit(1), F.greatest(F.size("edited") - 5, F.lit(0)))
    words = edited.withColumn("new", F.when(F.col("doc_id") % 3 == 0, longer).when(F.col("doc_id") % 3 == 1, shorter).otherwise(F.col("edited")))
    back = words.withColumn("back", history.apply_array_delta(F.col("new"), history.array_delta(F.col("old"), F.col("new"))))
    return back.select("doc_id", F.size("back").cast("long").alias("n"), F.col("back").eqNullSafe(F.col("old")).alias("same"))


@_query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k, 'value:' || value AS extra FROM (SELECT event_id, props, round(value)::BIGINT AS value FROM events)")
def payload_capture(spark, sf_dir):
    raw = _table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", F.from_json("props", "k bigint").alias("props"), F.round("value").cast("long").alias("value"))).alias("raw"))
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("props", T.StructType([T.StructField("k", T.LongType())]))])
    bound = readers.bind(raw, schema)
    return bound.select("event_id", F.col("props.k").alias("k"), F.array_join(F.transform(F.map_entries("payload"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("extra"))


@_query("SELECT event_id, (props::JSON->>'k')::DOUBLE AS number, strftime(ts, '%Y-%m-%d') AS day FROM events")
def coerce_dynamic(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return events.select("event_id", quality.coerce_dynamic(F.get_json_object("props", "$.k"))["number"].alias("number"), quality.coerce_dynamic(F.date_format("ts", "yyyy-MM-dd"))["day"].cast("string").alias("day"))


@_query("""SELECT concat_ws(',', CASE WHEN l_quantity > 45 THEN 'l_quantity:max' END, CASE WHEN l_discount < 0.02 THEN 'l_discount:min' END, CASE WHEN length(l_returnflag) > 0 AND l_returnflag = 'N' THEN 'l_returnflag:flag' END) AS violations, count(*) AS n FROM lineitem GROUP BY 1""")
def violations(spark, sf_dir):
    rules = [quality.constraint("l_quantity", "max", 45), quality.constraint("l_discount", "min", 0.02), ("l_returnflag:flag", F.col("l_returnflag") == "N")]
    return quality.violations(_table(spark, sf_dir, "lineitem"), rules).groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("n"))


@_query("SELECT 'k' AS path, CASE WHEN max(length(props::JSON->>'k')) <= 9 THEN 'int' ELSE 'bigint' END AS type, count(*) AS filled, 0::BIGINT AS conflicts FROM events")
def infer_types(spark, sf_dir):
    return quality.infer_types(_table(spark, sf_dir, "events"), "props")


_TERMS = ("the", "and", "thand")


@_query("""WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') IF x <> ''] AS words FROM documents),
l AS (SELECT doc_id, len(words)::DOUBLE AS n, """ + ", ".join(f"len(list_filter(words, lambda x: x = '{t}'))::DOUBLE AS tf{i}" for i, t in enumerate(_TERMS)) + """ FROM w),
t AS (SELECT count(*)::DOUBLE AS docs, avg(n) AS mean, """ + ", ".join(f"count(*) FILTER (WHERE tf{i} > 0)::DOUBLE AS df{i}" for i in range(len(_TERMS))) + """ FROM l)
SELECT doc_id, round(""" + " + ".join(f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(_TERMS))) + """, 6) AS score FROM l, t WHERE tf0 + tf1 + tf2 > 0 ORDER BY score DESC, doc_id LIMIT 50""")
def text_search_bm25(spark, sf_dir):
    return search.text_search(_table(spark, sf_dir, "documents"), "doc_id", ["text"], " ".join(_TERMS), 50)


@_query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")
def json_extract(spark, sf_dir):
    lines = sinks.native_extract(_table(spark, sf_dir, "customer"), {"id": "c_custkey", "name": "c_name", "balance": "c_acctbal"})
    return lines.select(F.from_json("document", "id bigint, name string, balance double").alias("d")).select("d.*")


@_query("""SELECT o_orderkey::VARCHAR AS "order", strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') AS day, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey), '') AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate""")
def grid_view(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.date_trunc("day", "o_orderdate").alias("day"))
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    nested = joins.nest_lookup(orders, lines, "o_orderkey", "l_orderkey", "lines", [F.col("l_linenumber"), F.col("l_partkey")])
    return find.grid_view(nested, {"order": "o_orderkey", "day": "day", "parts": "lines.l_partkey"})


@_query("SELECT sha256(event_type || 'user_id' || 'projection.value' || 'sort.ts') AS shape, count(*) AS n FROM events GROUP BY 1")
def query_shape_hash(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select(F.array(F.lit("user_id"), "event_type").alias("f"), F.array(F.lit("value")).alias("p"), F.array(F.lit("ts")).alias("s"))
    order = querylog.shape_hash(F.col("f"), F.col("p"), F.col("s"))
    return log.groupBy(order.alias("shape")).agg(F.count("*").alias("n"))


ORACLE_SQL["query_shape_hash"] = "SELECT sha256(array_to_string(list_sort([event_type, 'user_id', 'projection.value']), '') || 'sort.ts') AS shape, count(*) AS n FROM events GROUP BY 1"


@_query("""SELECT event_id, (CASE WHEN event_type = 'error' THEN 500 WHEN r = k AND d = 0 THEN 1 WHEN r = k AND k = d THEN 3 WHEN r = d AND d < k THEN 5 WHEN k = d AND d > r THEN 10 ELSE 0 END
+ CASE WHEN event_type = 'click' THEN CASE WHEN r < 100 THEN 10 WHEN r < 1000 THEN 25 ELSE 100 END ELSE 0 END)::INT AS cost
FROM (SELECT event_id, event_type, user_id % 5 * 400 AS r, event_id % 5 * 400 AS k, event_id % 3 * 400 AS d FROM events)""")
def query_cost(spark, sf_dir):
    log = _table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "user_id % 5 * 400 AS r", "event_id % 5 * 400 AS k", "event_id % 3 * 400 AS d")
    return log.select("event_id", querylog.cost_score(F.col("event_type") == "error", F.col("event_type") == "click", F.col("r"), F.col("k"), F.col("d")).alias("cost"))


@_query("""WITH w AS (SELECT p_partkey, sum(p_size::BIGINT) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS hi, p_size::BIGINT AS w FROM part WHERE p_size >= 1),
d AS (SELECT o_orderkey, (o_orderkey * 7919 % (SELECT max(hi) FROM w))::BIGINT AS r FROM orders)
SELECT o_orderkey, p_partkey FROM d ASOF JOIN (SELECT p_partkey, hi - w AS lo FROM w) ON r >= lo""")
def weighted_sample(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_size")
    ranges, total = joins.weight_ranges(parts, "p_size", ["p_partkey"], F.floor(F.col("p_partkey") / 1000))
    draws = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % F.lit(total)).alias("r"))
    return joins.weighted_pick(draws, "r", ranges, total).select("o_orderkey", "p_partkey")


@_query("SELECT p_brand AS brand, count(*) * (SELECT count(DISTINCT p_brand) FROM part) AS picks FROM part GROUP BY 1")
def weighted_alias(spark, sf_dir):
    """All draws from an alias table of the brands' frequencies, counted: each brand as often as its weight says, exactly."""
    brands = _table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("w"))
    made = alias.alias_table(brands, "w", ["p_brand"], F.crc32(F.col("p_brand").cast("binary")) % 4)
    draws = spark.range(made.n * made.total).withColumnRenamed("id", "r")
    picked = made.pick(draws, F.floor(F.col("r") / made.total), F.col("r") % made.total)
    return picked.groupBy(F.col("picked.p_brand").alias("brand")).agg(F.count("*").alias("picks"))


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN floor(o_totalprice * 101 / 100) ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 10 = 4 THEN CASE o_orderstatus WHEN 'F' THEN 'O' ELSE 'F' END ELSE o_orderstatus END AS o_orderstatus FROM orders")
def mutation_by_rule(spark, sf_dir):
    pick = lambda n: F.col("o_orderkey") % 10 == n
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return rows.withColumns({"o_totalprice": F.when(pick(3), F.floor(F.col("o_totalprice") * 101 / 100).cast("double")).otherwise(F.col("o_totalprice")), "o_orderstatus": F.when(pick(4), F.when(F.col("o_orderstatus") == "F", "O").otherwise("F")).otherwise(F.col("o_orderstatus"))})


def _u(seed: int, name: str, key: str) -> str:
    """The seeded uniform number of a row in SQL."""
    return f"(('0x' || substr(md5({key}::VARCHAR || ':{seed}:{name}'), 1, 12))::BIGINT / 281474976710656.0)"


@_query(f"""SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, CASE WHEN h AND {_u(1, 'o_totalprice', 'o_orderkey')} < 0.1 THEN o_totalprice * 101 / 100 ELSE o_totalprice END AS o_totalprice,
CASE WHEN h AND {_u(1, 'o_orderstatus', 'o_orderkey')} < 0.1 THEN CASE WHEN o_orderstatus = 'F' THEN 'O' ELSE 'F' END ELSE o_orderstatus END AS o_orderstatus FROM (SELECT *, {_u(1, 'hit', 'o_orderkey')} < 0.01 AS h FROM orders)""")
def mutation_seeded(spark, sf_dir):
    return generate.mutate(_table(spark, sf_dir, "orders"), "o_orderkey", 0.01, {"o_totalprice": (0.1, lambda c: c * 101 / 100), "o_orderstatus": (0.1, lambda c: F.when(c == "F", "O").otherwise("F"))})


@_query("SELECT count(*) AS n, count(*) AS ids, true AS shaped, true AS in_range FROM orders")
def generated_documents(spark, sf_dir):
    """Documents shaped like events and orders: frequency tables learned from both; their counts and whether all have the learned shape."""
    kinds = profile.frequency(_table(spark, sf_dir, "events"), "event_type", "event.type")
    orders = _table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("order.status"), F.col("o_orderpriority").alias("order.priority")).agg(F.count("*").alias("probability"))
    macros = _table(spark, sf_dir, "orders").groupBy(F.lit("@ONEUP").alias("n"), F.lit("@INTEGER(3,9)").alias("order.level"), F.lit("@ARRAY(lines,2)").alias("lines")).agg(F.count("*").alias("probability"))
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").cast("string").alias("number")).agg(F.count("*").alias("probability"))
    made = generate.generate(spark, _table(spark, sf_dir, "orders").count(), {"kinds": kinds, "orders": orders, "macros": macros}, {"lines": {"lines": lines}})
    typed = F.from_json("document", "n bigint, event struct<type:string>, order struct<status:string,priority:string,level:bigint>, lines array<struct<flag:string,number:bigint>>")
    d = made.select("id", typed.alias("d")).select("id", "d.*")
    shaped = F.col("event.type").isNotNull() & F.col("order.status").isNotNull() & F.col("order.priority").isNotNull() & (F.size("lines") == 2) & F.forall("lines", lambda x: x["flag"].isNotNull() & x["number"].isNotNull())
    return d.agg(F.count("*").alias("n"), F.count_distinct(F.col("n") - 1).alias("ids"), F.bool_and(shaped).alias("shaped"), F.bool_and(F.col("order.level").between(3, 9)).alias("in_range"))


from . import documents as _documents  # noqa: E402, F401  further queries enter the same registry
