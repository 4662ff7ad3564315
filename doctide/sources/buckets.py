"""A keyed table in hash buckets under a manifest: a batch rewrites the buckets that it changes and publishes one manifest.

A row lies in the bucket of its key's hash; a bucket's rows lie in the folder of the batch that wrote them last. The
manifest of a batch is one small file: for each bucket the batch that wrote it, the folders of the history, counters and
totals. It appears by renaming, so readers see a batch whole or not at all, and what a failed attempt wrote is never
named. A repeated batch changes nothing. Folders that no kept manifest names are deleted. History folders of batches are
merged in levels, ``FAN`` at a time, so that a manifest names few of them and a row is rewritten once a level.

A manifest's size goes with the number of buckets, which is fixed when the table is made; the driver holds that and
nothing of the rows. Choose buckets for a partition's worth of rows each.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: History folders of one level that are merged to one of the next.
FAN = 16
BUCKET = "__bucket"


@dataclass(frozen=True)
class Manifest:
    """What a published batch of a table consists of."""

    batch: int
    key: str
    n_buckets: int
    schema: str
    #: For each bucket that has rows, the batch that wrote it.
    written: dict[str, int] = field(default_factory=dict)
    #: Folders of the history, oldest first, as level and batch of their last rows.
    history: list[tuple[int, int]] = field(default_factory=list)
    #: Counters of all batches so far, and whatever else a writer adds up.
    totals: dict[str, float] = field(default_factory=dict)

    @property
    def row_type(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


def bucket_of(key: Column, n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_buckets)).cast("int")


class BucketTable:
    """The table below a folder. One writer at a time; readers at any time."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(), self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _put(self, name: str, text: str) -> None:
        """A file that appears whole or not at all."""
        fs, part = self._fs(), self._path(f"_{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.mkdirs(self._path(name).getParent())
        if not fs.rename(part, self._path(name)):
            fs.delete(part, False)
            if not fs.exists(self._path(name)):
                raise OSError(f"{self.root}/{name} could not be written")

    def _get(self, name: str) -> str:
        read = self._fs().open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(read)).decode()
        finally:
            read.close()

    def manifest(self, batch: int | None = None) -> Manifest | None:
        """That of a batch, or the newest; None if nothing was published."""
        if batch is None:
            batch = max((int(n) for n in self._names("manifests")), default=None)
            if batch is None:
                return None
        said = json.loads(self._get(f"manifests/{batch}"))
        return Manifest(**said | {"history": [tuple(h) for h in said["history"]]})

    def batch_time(self, batch: int) -> datetime:
        """The time of a batch: set by its first attempt and found again by later ones."""
        if not (found := [n for n in self._names("times") if n.startswith(f"{batch}-")]):
            self._put(f"times/{batch}-{int(time.time() * 1_000_000)}", "")
            found = [n for n in self._names("times") if n.startswith(f"{batch}-")]
        return datetime.fromtimestamp(min(int(n.split("-")[1]) for n in found) / 1_000_000)

    def state(self, manifest: Manifest | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a manifest (the newest), of all buckets or the given ones; only their files are read."""
        known = manifest or self.manifest()
        if known is None:
            raise ValueError(f"{self.root}: nothing published")
        wanted = known.written.items() if buckets is None else [(str(b), known.written[str(b)]) for b in buckets if str(b) in known.written]
        paths = [f"{self.root}/state/batch={n}/{BUCKET}={b}" for b, n in wanted]
        if not paths:
            return self.spark.createDataFrame([], known.row_type)
        return self.spark.read.schema(known.row_type).parquet(*paths)

    def history(self, manifest: Manifest | None = None) -> DataFrame:
        """History rows of published batches, each once."""
        known = manifest or self.manifest()
        if known is None or not known.history:
            return self.spark.createDataFrame([], "history_id string, record_id string, ts timestamp, seq long, type string, changes map<string,string>")
        return self.spark.read.parquet(*[f"{self.root}/history/{level}-{batch}" for level, batch in known.history])

    def start(self, schema: T.StructType, key: str, n_buckets: int) -> Manifest:
        """The manifest of an empty table, which is published with its first batch."""
        return Manifest(-1, key, n_buckets, schema.json())

    def create(self, schema: T.StructType, key: str, n_buckets: int) -> Manifest:
        """Publish the empty table, unless there is one."""
        known = self.manifest()
        if known is None:
            known = self.start(schema, key, n_buckets)
            self.publish(known)
        return known

    def touched(self, manifest: Manifest, keys: Column, rows: DataFrame) -> list[int]:
        """Buckets that keys of ``rows`` fall into; at most as many as the table has."""
        return sorted(r[0] for r in rows.select(bucket_of(keys, manifest.n_buckets)).distinct().collect())

    def write(self, manifest: Manifest, batch: int, rows: DataFrame, buckets: list[int]) -> dict[str, int]:
        """Write all rows of ``buckets`` under the batch. Returns which batch then holds which bucket."""
        path = f"{self.root}/state/batch={batch}"
        placed = rows.withColumn(BUCKET, bucket_of(F.col(manifest.key), manifest.n_buckets)).filter(F.col(BUCKET).isin(buckets))
        placed.repartition(F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
        left = {n.split("=")[1] for n in self._names(f"state/batch={batch}") if n.startswith(f"{BUCKET}=")}
        gone = {str(b) for b in buckets}
        return {b: n for b, n in manifest.written.items() if b not in gone} | dict.fromkeys(sorted(left), batch)

    def append(self, manifest: Manifest, batch: int, rows: DataFrame, put: Callable[[DataFrame, str], None] | None = None, merged: Callable[[DataFrame, bool], DataFrame] | None = None) -> list[tuple[int, int]]:
        """Write history rows of the batch, and merge folders where a level is full. Returns the folders of the history.

        ``put`` writes rows to a folder; ``merged`` makes the rows of a merged folder, told whether it is the oldest.
        """
        put = put or (lambda df, path: df.write.mode("overwrite").parquet(path))
        put(rows, f"{self.root}/history/0-{batch}")
        folders = [*manifest.history, (0, batch)]
        level = 0
        while len(full := [f for f in folders if f[0] == level]) >= FAN:
            into = (level + 1, full[-1][1])
            each = [self.spark.read.schema(rows.schema).parquet(f"{self.root}/history/{lv}-{n}").select(*rows.columns) for lv, n in full]
            parts = reduce(DataFrame.unionByName, each)
            put(merged(parts, full[0] == folders[0]) if merged else parts, f"{self.root}/history/{into[0]}-{into[1]}")
            folders = [f for f in folders if f[0] != level] + [into]
            folders.sort(key=lambda f: f[1])
            level += 1
        return folders

    def history_of(self, manifest: Manifest, schema: T.StructType, buckets: list[int]) -> DataFrame:
        """History rows of the given buckets, where folders are partitioned by bucket; only their files are read."""
        names = {f"{level}-{batch}" for level, batch in manifest.history}
        found = [f"{self.root}/history/{n}/{BUCKET}={b}" for n in sorted(names) for b in buckets if self._fs().exists(self._path(f"history/{n}/{BUCKET}={b}"))]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def publish(self, manifest: Manifest) -> None:
        """Make the manifest's batch the newest."""
        self._put(f"manifests/{manifest.batch}", json.dumps(asdict(manifest)))

    def expire(self, keep: int = 2) -> None:
        """Delete manifests but the newest ``keep``, and the folders that none of those names."""
        fs = self._fs()
        batches = sorted(int(n) for n in self._names("manifests"))
        for old in batches[:-keep]:
            fs.delete(self._path(f"manifests/{old}"), False)
        kept = [self.manifest(b) for b in batches[-keep:]]
        if not kept:
            return
        last = max(m.batch for m in kept)
        live = {f"batch={n}": {b for m in kept for b, by in m.written.items() if by == n} for m in kept for n in m.written.values()}
        for name in self._names("state"):
            if int(name.split("=")[1]) > last:
                continue  # a batch at work
            for part in self._names(f"state/{name}") if name in live else []:
                if part.startswith(f"{BUCKET}=") and part.split("=")[1] not in live[name]:
                    fs.delete(self._path(f"state/{name}/{part}"), True)
            if name not in live:
                fs.delete(self._path(f"state/{name}"), True)
        named = {f"{level}-{batch}" for m in kept for level, batch in m.history}
        for name in self._names("history"):
            if name not in named and int(name.split("-")[1]) <= last:
                fs.delete(self._path(f"history/{name}"), True)
        for name in self._names("changes"):
            if int(name) < last:
                fs.delete(self._path(f"changes/{name}"), True)
        for name in self._names("times"):
            if int(name.split("-")[0]) <= last:
                fs.delete(self._path(f"times/{name}"), False)


def apply_batch(
    table: BucketTable, rows: DataFrame, batch: int, key: str, schema: T.StructType, strategy: str = "REPLACE", n_buckets: int = 64, batch_ts: Column | None = None, keep: int = 2,
    pre_write: Callable[[DataFrame], DataFrame] | None = None, post_write: Callable[[DataFrame, int], None] | None = None, more_totals: dict[str, float] | None = None, **options,
) -> Manifest:
    """Apply keyed rows to the table as one batch and publish it; a batch that was published before is left as it is.

    Buckets without a key of the batch are neither read nor written; of the others, only those in which some row changes
    are written. A batch that changes nothing publishes a manifest that names the same folders. ``post_write`` sees the
    changes when all is written, before it is published. ``schema`` and ``n_buckets`` hold for a table that is new.
    """
    from ..operators.history import history_rows
    from ..operators.upsert import upsert, with_bookkeeping

    spark = table.spark
    known = table.manifest()
    if known is not None and known.batch >= batch:
        return known
    if known is None:
        known = table.start(with_bookkeeping(spark.createDataFrame([], schema)).schema, key, n_buckets)
    rows = pre_write(rows) if pre_write else rows
    at = batch_ts if batch_ts is not None else F.lit(table.batch_time(batch))
    old = table.state(known, table.touched(known, F.col(key), rows))
    made = upsert(old, rows, key, strategy, str(batch), at, **options)
    changes_at = f"{table.root}/changes/{batch}"
    made.changes.write.mode("overwrite").parquet(changes_at)
    changes = spark.read.schema(made.changes.schema).parquet(changes_at)
    count = lambda kind: F.count(F.when(F.col("type") == kind, 1)).alias(f"{kind}s")
    counted = changes.agg(*map(count, ("insert", "update", "delete", "conflict"))).first().asDict()
    totals = {k: known.totals.get(k, 0) + v for k, v in (counted | (more_totals or {})).items()}
    changed = table.touched(known, F.col("record_id"), changes.filter("type <> 'conflict'"))
    written, folders = known.written, known.history
    if changed:
        written = table.write(known, batch, made.state, changed)
        folders = table.append(known, batch, history_rows(changes, batch))
    if post_write:
        post_write(changes, batch)
    new = replace(known, batch=batch, written=written, history=folders, totals={**known.totals, **totals})
    table.publish(new)
    table.expire(keep)
    return new


def ensure_tables(spark: SparkSession, tables: dict[str, tuple[str, T.StructType, str]], create: bool = True, n_buckets: int = 64) -> DataFrame:
    """Before a load: that each table (folder, columns, key) is there, with its history and the columns asked for.

    Missing ones are made, or stop the load with ``create=False``. A row a table: name, present (before), created, batch,
    and schema_diff, the columns that differ or are missing.
    """
    from ..operators.upsert import with_bookkeeping

    rows = []
    for name, (root, schema, key) in tables.items():
        table = BucketTable(spark, root)
        known = table.manifest()
        if known is None and not create:
            raise ValueError(f"table {name} is missing at {root}")
        there = known is not None
        known = known or table.create(with_bookkeeping(spark.createDataFrame([], schema)).schema, key, n_buckets)
        have = {f.name: f.dataType.simpleString() for f in known.row_type}
        diff = ",".join(sorted(f"{f.name}:{have.get(f.name, 'missing')}" for f in schema if have.get(f.name) != f.dataType.simpleString()))
        rows.append((name, there, not there, known.batch, diff))
    return spark.createDataFrame(rows, "name string, present boolean, created boolean, batch long, schema_diff string")
