"""Sinks: written tables, JSON extracts, frequency tables and quarantine."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the one that all machines share (``spark.checkpoint.dir``); local sessions may do without."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="doctide-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/doctide-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder, which cuts its lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def json_lines(df: DataFrame, payload: str | None = None) -> DataFrame:
    """``document``: one JSON text a row, nulls left out, ISO times, payload keys at the top level.

    The payload maps keys to variants, which are written as what they are, JSON nulls too, or to texts, which are written
    as strings; a key without a value is left out. Declared columns win over equal keys.
    """
    style = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "ignoreNullFields": "true"}
    declared = [c for c in df.columns if c != payload]
    own = F.to_json(F.struct(*declared), style) if declared else F.lit("{}")
    if not payload:
        return df.select(own.alias("document"))
    extra = F.coalesce(F.to_json(F.map_filter(payload, lambda k, v: v.isNotNull() & ~k.isin(*declared))), F.lit("{}"))
    glue = F.when((own == "{}") | (extra == "{}"), "").otherwise(",")
    return df.select(F.concat(F.regexp_extract(own, r"(?s)^(.*)\}$", 1), glue, F.regexp_extract(extra, r"(?s)^\{(.*)$", 1)).alias("document"))


def native_extract(df: DataFrame, fields: Mapping[str, str | Column]) -> DataFrame:
    """``document`` of an explicit projection: output name -> path or column."""
    return df.select(F.to_json(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in fields.items()]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"}).alias("document"))


def write_lines(documents: DataFrame, path: str) -> None:
    documents.select("document").write.mode("overwrite").text(path)


def write_frequency_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def quarantine(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
