"""Readers: JSON documents in three layouts, delimited files, frequency tables, JDBC and topics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json_split import split_objects

def read_json_text(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """``raw`` JSON texts and ``broken`` ones. Layouts: lines; array or concatenated, files of any size, each read by many tasks."""
    if layout == "lines":
        return spark.read.text(path).select(F.col("value").alias("raw"), F.try_parse_json("value").isNull().alias("broken")).filter("trim(raw) <> ''")
    if layout not in ("array", "concatenated"):
        raise ValueError(f"unknown layout: {layout}")
    return split_objects(spark, path, layout)


def bind(df: DataFrame, schema: T.StructType, raw: str = "raw", payload: str | None = "payload") -> DataFrame:
    """Declared columns from JSON text; every other top-level key goes to a map of variants, which keep what each value was."""
    typed = F.from_json(F.col(raw), schema)
    out = [typed[f.name].alias(f.name) for f in schema]
    if payload:
        keys = F.from_json(F.col(raw), "map<string,variant>")
        declared = [f.name for f in schema]
        out.append(F.map_filter(keys, lambda k, _: ~k.isin(*declared)).alias(payload))
    return df.select(*out)


def read_documents(spark: SparkSession, path: str, schema: T.StructType, layout: str = "lines", payload: str | None = "payload") -> tuple[DataFrame, DataFrame]:
    """Bound documents, and the broken texts as a quarantine frame."""
    text = read_json_text(spark, path, layout)
    return bind(text.filter("NOT broken"), schema, "raw", payload), text.filter("broken").select("raw")


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "|", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("header", header).option("nullValue", "").csv(path)


def clean_rows(df: DataFrame, header_column: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Repeated header rows dropped, empty strings nulled, the first row of each key kept by the given order."""
    from ..operators.joins import first_per_key

    rows = df.filter(~F.col(header_column).eqNullSafe(F.lit(header_column)))
    text = {f.name: F.when(F.col(f.name) != "", F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.StringType)}
    return first_per_key(rows.withColumns(text), list(keys), [F.col(c) for c in order])


def read_frequency_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Frequency tables by name from the csv, csv.gz and written csv folders of a folder, each with a header."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    names = sorted(s.getPath().getName() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at))
    read = spark.read.option("header", True).option("escape", '"')
    return {n.removesuffix(".gz").removesuffix(".csv"): read.csv(f"{folder}/{n}") for n in names if n.removesuffix(".gz").endswith(".csv")}


def read_jdbc(spark: SparkSession, url: str, query: str, key: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A relational query read in key ranges."""
    return spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=partitions, **options).load()


def stream_documents(spark: SparkSession, source: str, schema: T.StructType, **options: str) -> DataFrame:
    """A stream of bound documents with their raw text; source is a topic server (``kafka``) or a folder of JSON lines (``text``)."""
    if source == "kafka":
        raw = spark.readStream.format("kafka").option("startingOffsets", "earliest").options(**options).load().select(F.col("value").cast("string").alias("raw"), F.col("offset").alias("seq"))
    else:
        path = options.pop("path")
        raw = spark.readStream.format("text").options(**options).load(path).select(F.col("value").alias("raw"), F.unix_micros(F.col("_metadata.file_modification_time")).alias("seq"))
    typed = F.from_json(F.col("raw"), schema)
    return raw.select("raw", "seq", F.try_parse_json("raw").isNull().alias("broken"), typed.alias("doc"))
