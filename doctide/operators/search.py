"""Relevance search by BM25."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import sinks
from ..sources.buckets import BUCKET, BucketTable, bucket_of

K1, B = 1.2, 0.75


def tokens(*fields: str) -> Column:
    """Lower-case words of one or several string fields."""
    return _words(F.concat_ws(" ", *fields))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """The distinct words of a query, cut as texts are."""
    return spark.range(1).select(F.array_distinct(_words(F.lit(query)))).first()[0]


def _is(term: str):
    return lambda x: x == F.lit(term)


def _term_counts(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """A row for each distinct word of each row: term, key, length and tf; and one of each row with term null and tf 1.

    Words are counted inside of their row, as runs of its sorted words: nothing is shuffled, and texts are cut once.
    """
    words = df.select(F.col(key), F.sort_array(tokens(*fields)).alias("words"))
    # A run ends where another word follows, or none; 0 stands for the row itself.
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1))), lambda i: ~F.get("words", i).eqNullSafe(F.get("words", i - 1)))
    words = words.select(key, "words", F.concat(F.array(F.lit(0)), ends).alias("ends"))
    runs = words.select(key, "words", "ends", F.posexplode_outer("ends").alias("run", "end"))  # not outer, words would be cut once more to filter by their number
    tf = F.when(F.col("run") > 0, F.col("end") - F.get("ends", F.col("run") - 1)).otherwise(1).cast("long")
    return runs.select(F.get("words", F.col("end") - 1).alias("term"), key, F.size("words").alias("length"), tf.alias("tf"))


def postings(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """term, key, tf and document length, to be kept as an index table."""
    return _term_counts(df, key, fields).filter("term IS NOT NULL").groupBy("term", key, "length").agg(F.sum("tf").alias("tf"))


def text_search(df: DataFrame, key: str, fields: Sequence[str], query: str, limit: int = 1000, where: Column | None = None, skip: int = 0) -> DataFrame:
    """key and score of rows with any query term, best first. Texts are cut once: their lengths and counts of the terms are written and read twice."""
    terms = query_terms(df.sparkSession, query)
    words = df.select(F.col(key), tokens(*fields).alias("words"), (where if where is not None else F.lit(True)).alias("ok"))
    counts = [F.size(F.filter("words", _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    counted = sinks.written(words.select(key, "ok", F.size("words").alias("length"), *counts), "counted")
    totals = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))])
    scored = counted.filter(F.col("ok") & (sum((F.col(f"tf{i}") for i in range(len(terms))), F.lit(0)) > 0)).crossJoin(F.broadcast(totals))  # one row of totals
    parts = F.lit(0.0)
    for i in range(len(terms)):
        tf, n = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - n + 0.5) / (n + 0.5))
        parts = parts + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return scored.select(key, F.round(parts, 6).alias("score")).orderBy(F.desc("score"), key).offset(skip).limit(limit)


def text_fields(df: DataFrame, path: str | Sequence[str]) -> list[str]:
    """Field names; the wildcard ``*`` stands for all string leaves, also inside of objects."""
    if path != "*":
        return [path] if isinstance(path, str) else list(path)

    def leaves(schema: T.StructType, at: str = "") -> list[str]:
        return [x for f in schema for x in (leaves(f.dataType, f"{at}{f.name}.") if isinstance(f.dataType, T.StructType) else [at + f.name] if isinstance(f.dataType, T.StringType) else [])]

    return leaves(df.schema)


def indexed_search(index: DataFrame, key: str, query: str, n_rows: int, mean_length: float, limit: int | None = 1000, skip: int = 0) -> DataFrame:
    """key and score from a ``postings`` table; only the query terms' rows of the index are read, and no text."""
    terms = query_terms(index.sparkSession, query)
    found = index.filter(F.col("term").isin(terms))
    idf = found.groupBy(F.col("term").alias("of")).agg(F.count("*").alias("n")).select("of", F.log(1 + (F.lit(float(n_rows)) - F.col("n") + 0.5) / (F.col("n") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean_length)))
    scores = found.join(F.broadcast(idf), F.col("term") == F.col("of")).groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))  # one row a query term
    return scores if limit is None else scores.orderBy(F.desc("score"), key).offset(skip).limit(limit)


def compound_search(df: DataFrame, key: str, texts: Sequence[tuple[str, str | Sequence[str]]], where: Column | None = None, limit: int = 1000, skip: int = 0) -> DataFrame:
    """key and score of rows that match every (query, path) clause and the condition; the clauses' scores are summed."""
    out: DataFrame | None = None
    for query, path in texts:
        fields = text_fields(df, path)
        index = postings(df, key, fields)
        totals = df.select(F.size(tokens(*fields)).alias("n")).agg(F.count("*").alias("rows"), F.avg("n").alias("mean")).first()
        found = indexed_search(index, key, query, totals["rows"], totals["mean"] or 1.0, None)
        out = found if out is None else out.join(found.withColumnRenamed("score", "__more"), key).select(key, (F.col("score") + F.col("__more")).alias("score"))
    assert out is not None
    if where is not None:
        out = out.join(df.filter(where).select(key).distinct(), key, "left_semi")
    return out.select(key, F.round("score", 6).alias("score")).orderBy(F.desc("score"), key).offset(skip).limit(limit)


#: The bucket of rows that stand for documents: by what a batch changes the number of rows and of their words.
_DOCUMENTS = -1


class KeptIndex:
    """Postings kept beside a table, brought forward by its changes, in buckets by term.

    A change appends its rows: for each term of a row's new version its count, for each of the old one 0. The newest
    batch's word on a term and row is what holds, a count before a 0 of the same batch. Rows are dealt out once, as they are
    written; a batch's numbers of rows and words are read from a folder of its own. Appended folders are merged in levels as
    histories are, and what has gone is left out of the oldest. A search reads the buckets of its terms and nothing of the
    documents; the number of rows and their lengths stand in the manifest. A bucket's rows are dealt out to ``spread``
    files, so that a term that most rows hold is no single task's work. ``key`` is the documents' key, whose type
    ``schema`` tells.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, fields: Sequence[str], schema: T.StructType, n_buckets: int = 64, spread: int = 4) -> None:
        self.table, self.key, self.fields, self.n_buckets, self.spread = BucketTable(spark, root), key, list(fields), n_buckets, spread
        self.rows = T.StructType().add("term", "string").add(key, schema[key].dataType).add("length", "integer").add("tf", "long").add("batch", "long")

    def _put(self, rows: DataFrame, path: str) -> None:
        placed = rows.withColumn(BUCKET, F.when(F.col("term").isNull(), _DOCUMENTS).otherwise(bucket_of(F.col("term"), self.n_buckets)))
        placed.repartition(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.spread))).write.mode("overwrite").partitionBy(BUCKET).parquet(path)

    def _newest(self, rows: DataFrame, oldest: bool = True) -> DataFrame:
        one = rows.filter("term IS NOT NULL").groupBy("term", self.key).agg(F.max_by(F.struct("length", "tf", "batch"), F.struct("batch", "tf")).alias("r")).select("term", self.key, "r.*")
        return one.filter("tf > 0") if oldest else one

    def _changes(self, before: DataFrame, after: DataFrame, batch: int) -> DataFrame:
        """Rows of a batch. Those with term null are the documents that go and come: -1 and 1 as tf, and their lengths."""
        words = before.select(F.col(self.key), tokens(*self.fields).alias("words"))
        terms = words.select(self.key, F.size("words").alias("size"), F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("words")).alias("terms"))
        gone = terms.select(self.key, "size", F.explode_outer("terms").alias("term"))
        of_row = F.col("term").isNull()
        gone = gone.select("term", self.key, F.when(of_row, -F.col("size")).otherwise(0).alias("length"), F.when(of_row, -1).otherwise(0).cast("long").alias("tf"))
        return gone.unionByName(_term_counts(after, self.key, self.fields)).withColumn("batch", F.lit(batch).cast("long")).select(*self.rows.names)

    def bring_forward(self, before: DataFrame, after: DataFrame, batch: int) -> None:
        """Take in a batch: changed rows as they were and as they are, each key at most once a side. A repeated batch changes nothing."""
        known = self.table.manifest() or self.table.start(self.rows, "term", self.n_buckets)
        if known.batch >= batch:
            return
        folders = self.table.append(known, batch, self._changes(before, after, batch), self._put, self._newest)
        came = self.table.history_of(replace(known, history=[(0, batch)]), self.rows, [_DOCUMENTS])
        more = came.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first().asDict()
        self.table.publish(replace(known, batch=batch, history=folders, totals={k: known.totals.get(k, 0) + v for k, v in more.items()}))
        self.table.expire()

    def found(self, query: str) -> DataFrame:
        """Postings of the query's terms as they hold now."""
        known, spark = self.table.manifest(), self.table.spark
        terms = query_terms(spark, query)
        if known is None or not terms:
            return spark.createDataFrame([], self.rows)
        asked = spark.createDataFrame([(t,) for t in terms], "term string")
        rows = self.table.history_of(known, self.rows, self.table.touched(known, F.col("term"), asked)).filter(F.col("term").isin(terms))
        return self._newest(rows)

    def search(self, query: str, limit: int | None = 1000, skip: int = 0) -> DataFrame:
        """key and score of rows with any term of the query, best first."""
        known = self.table.manifest()
        n, words = (known.totals.get("rows", 0), known.totals.get("words", 0)) if known else (0, 0)
        return indexed_search(self.found(query), self.key, query, n, words / n if n else 1.0, limit, skip)
