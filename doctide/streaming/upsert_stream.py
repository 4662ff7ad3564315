"""Continuous upsert of a document stream into a bucketed table."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..sources import sinks
from ..sources.buckets import BucketTable, Manifest, apply_batch

COUNTERS = ("inserts", "updates", "deletes", "conflicts", "broken")


class Holder:
    """Rows of micro-batches that wait, as folders by batch, until there are enough of them or none has come for a while."""

    def __init__(self, table: BucketTable, rows: int, idle: float, flush: Callable[[DataFrame, int], None]) -> None:
        self.table, self.root, self.rows, self.idle, self.flush = table, f"{table.root}/pending", rows, idle, flush
        self.lock, self.timer, self.arrived, self.failed = threading.RLock(), None, 0.0, None

    def add(self, batch: DataFrame, number: int) -> None:
        """Keep a micro-batch; a repeated one takes its own place again. Flushes if that makes enough rows."""
        with self.lock:
            if self.failed:
                raise self.failed
            batch.write.mode("overwrite").parquet(f"{self.root}/batch={number}")
            self.arrived = time.monotonic()
            spark = batch.sparkSession
            if spark.read.schema(batch.schema).parquet(*self._waiting(spark).values()).count() >= self.rows:
                self.release(spark)
            else:
                self._wait(spark)

    def _waiting(self, spark: SparkSession) -> dict[int, str]:
        """Folders by batch; those of batches that a publication covers, left by a driver lost just then, are deleted."""
        fs, at = sinks.file_system(spark, self.root)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        known, out = self.table.manifest(), {}
        for number in sorted(int(n.split("=")[1]) for n in names if n.startswith("batch=")):
            path = f"{self.root}/batch={number}"
            if known is not None and number <= known.batch:
                fs.delete(sinks.file_system(spark, path)[1], True)
            else:
                out[number] = path
        return out

    def _wait(self, spark: SparkSession) -> None:
        if self.timer:
            self.timer.cancel()
        self.timer = threading.Timer(self.idle, self._quiet, (spark,))
        self.timer.daemon = True
        self.timer.start()

    def _quiet(self, spark: SparkSession) -> None:
        with self.lock:
            if time.monotonic() - self.arrived >= self.idle:
                try:
                    self.release(spark)
                except Exception as error:  # seen by the next micro-batch; the rows go on waiting
                    self.failed = error

    def release(self, spark: SparkSession) -> None:
        """Flush what waits as the batch of its newest number."""
        with self.lock:
            if self.timer:
                self.timer.cancel()
            if waiting := self._waiting(spark):
                self.flush(spark.read.parquet(*waiting.values()), max(waiting))
                self._waiting(spark)


@dataclass
class Stream:
    """A running upsert: its query, and what its published batches did, added up."""

    query: StreamingQuery
    table: BucketTable
    holder: Holder | None = field(default=None)

    def finish(self) -> None:
        """Wait for a stream that works off what is there; what was held back is applied, too."""
        self.query.awaitTermination()
        if self.holder:
            self.holder.release(self.table.spark)

    def drain(self) -> None:
        """Work off what has arrived, then stop."""
        self.query.processAllAvailable()
        self.query.stop()
        if self.holder:
            self.holder.release(self.table.spark)

    def state(self) -> DataFrame:
        return self.table.state()

    def counters(self) -> DataFrame:
        """One row: inserts, updates, deletes, conflicts and broken messages of all published batches."""
        known = self.table.manifest()
        row = [int(known.totals.get(c, 0)) if known else 0 for c in COUNTERS]
        return self.table.spark.createDataFrame([row], ", ".join(f"{c} long" for c in COUNTERS))


def stream_upsert(
    documents: DataFrame, root: str, schema: T.StructType, key: str, checkpoint: str, strategy: str = "REPLACE", delete: str | None = None, every: str | None = "1 second",
    pre_write: Callable[[DataFrame], DataFrame] | None = None, post_write: Callable[[DataFrame, int], None] | None = None, keep_states: int = 2, n_buckets: int = 64,
    flush_rows: int | None = None, idle_seconds: float = 1.0,
) -> Stream:
    """Start the stream: each micro-batch is collapsed (last of a key wins), applied and published once.

    ``documents`` comes from ``stream_documents``. Broken messages and those without a key go to quarantine. A batch that
    was published before is skipped, so a repeated one changes nothing; one that failed before writes the same rows with
    the same time again, as its time is written first. A batch rewrites only the buckets that it changes. ``post_write``
    sees the changes when history and state are written, before they are published. ``every=None`` works off what is
    there and stops. The newest ``keep_states`` states are kept.

    With ``flush_rows``, micro-batches are held back until that many rows wait, or none has come for ``idle_seconds``;
    the source's rate bound (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) says how many come at a time. What waits
    is kept in the table's folder, so a restart goes on with it.
    """
    table = BucketTable(documents.sparkSession, root)
    plain = T.StructType([f for f in schema if f.name != delete])

    def flush(batch: DataFrame, number: int) -> None:
        known: Manifest | None = table.manifest()
        if known is not None and known.batch >= number:
            return
        batch = batch.persist()
        try:
            bad = F.col("broken") | F.col(f"doc.{key}").isNull()
            sinks.quarantine(batch.filter(bad).select("raw"), f"{root}/quarantine", number)
            broken = batch.filter(bad).count()
            rows = batch.filter(~bad).select("doc.*", F.struct("seq", "row").alias("__order"))
            apply_batch(table, rows, number, key, plain, strategy, n_buckets, keep=keep_states, pre_write=pre_write, post_write=post_write, more_totals={"broken": broken}, delete=delete, order="__order")
        finally:
            batch.unpersist()

    holder = Holder(table, flush_rows, idle_seconds, flush) if flush_rows else None

    def take(batch: DataFrame, number: int) -> None:
        known = table.manifest()
        if known is not None and known.batch >= number:
            return
        rows = batch.withColumn("row", F.struct(F.lit(number).alias("batch"), F.monotonically_increasing_id().alias("at")))
        (holder.add if holder else flush)(rows, number)

    writer = documents.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    return Stream(query, table, holder)
