"""Helpers that the corpus operators share: bounded Arrow blocks and written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every contract here: space and the five controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch between the JVM and a Python worker.
BATCH_ROWS, BATCH_BYTES = 512, "8m"


def bound_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small enough for texts of any length; smaller bounds that the user has set stay.

    The bounds hold for the session from then on, since Spark reads them when the returned frame runs.
    """
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session that names none gets a temporary one."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="doctide-")
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to.rstrip("/")


class Scratch:
    """Tables of one job in the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/doctide-{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete tables that nothing reads any more."""
        for frame in frames:
            if (path := self.paths.pop(id(frame), None)) is not None:
                at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it."""
    return Scratch(df.sparkSession).write(df, label)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Regroup batches to blocks of about ``limit`` bytes of ``column``; a longer row makes a block of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start, n = 0, batch.num_rows
        lengths = [len(x) if (x := v.as_buffer()) is not None else 0 for v in batch.column(column)] if n else []
        for i, length in enumerate(lengths):
            if size and size + length > limit:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i
            size += length
        if n > start:
            held.append(batch.slice(start, n - start))
    if held:
        yield pa.Table.from_batches(held)


def utf8(block: pa.Table, column: str) -> list[bytes]:
    """The column's values as UTF-8, null as empty."""
    return [b"" if v is None else v for v in block.column(column).cast(pa.binary()).to_pylist()]


def crc_bucket(column: str, buckets: int):
    """crc32 of the id's decimal text, modulo ``buckets``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % buckets
