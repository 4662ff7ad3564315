"""WARC archives of pages with a two-level capture index.

Archives are gzip members, one a record, in files of up to ``FILE_BYTES``; equal payloads are stored once and
revisited. The index sorts lines by reversed-host URL key into shards, a file of compressed blocks each, and keeps a
sparse directory of each shard's blocks. A lookup finds the shard, binary-searches its directory, reads the block's
byte range, binary-searches the block and reads the records' byte ranges; ``fetch`` does so in tasks for any number of
URLs, ``lookup`` on the driver for one. All files are written under a temporary name and moved, so a repeated task
leaves whole files; they live in a folder that all executors share, reached through ``pyarrow.fs``.

Null html is an empty payload, a null URL the empty one; ids are of any type, and a null one counts as smaller than any.
Of equal payloads the row with the largest id is the response (all rows of that id, if it repeats), so ties and
repeated rows give a record each. A very long page is one record. An empty table makes no archive and an empty index.
Only the id, URL and html columns are read; others are free to have any name.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bound_batches, materialize, shared_dir

BLOCK_LINES = 1000
BLOCK_BYTES = 4 << 20
#: An archive file takes no further record beyond this size.
FILE_BYTES = 1 << 30
#: Parts that the rows of one payload are dealt out to.
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
_ESCAPED = {c: f"%{c:02X}" for c in [*range(33), 127]}
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def url_key(url: str | None) -> str:
    """The URL with its host's labels reversed, lower case, without scheme, leading www, port 80 or 443, and fragment.

    Spaces and line feeds are escaped, so that keys sort in a block's lines as they do in Spark.
    """
    url = (url or "").strip().translate(_ESCAPED)
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return "~" + url
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (parts.path or "/").lower()
    return key + (f"?{'&'.join(sorted(parts.query.lower().split('&')))}" if parts.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(headers: list[tuple[str, str]], body: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(body)}\r\n\r\n"
    job = zlib.compressobj(6, zlib.DEFLATED, 31)
    return job.compress(head.encode() + body + b"\r\n\r\n") + job.flush()


def _name(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


_LINE = {13: "%0D", 10: "%0A"}


def _headers(kind: str, page: object, url: str | None, sha: str, size: int) -> list[tuple[str, str]]:
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    return [("WARC-Type", kind), ("WARC-Record-ID", _name(page)), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response"), ("X-Payload-Length", str(size)), *([("X-Page-Id", str(page).translate(_LINE))] if page is not None else [])]


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers in lower case and the payload (after the HTTP head) of one compressed record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    fields = {k.lower(): v for k, v in fields.items()}
    body = rest[: int(fields["content-length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


class _Writer:
    """A file that appears under its name only when it is whole."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.temporary = f"{root}/{name}", f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
        self.out, self.size = self.fs.open_output_stream(self.temporary, compression=None), 0

    def add(self, data: bytes) -> int:
        """Append and tell where the data begins."""
        self.out.write(data)
        self.size += len(data)
        return self.size - len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.path)


_LINES = pa.schema([("key", pa.string()), ("page", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("digest", pa.string())])


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archives and return their capture lines: key, page (as text), file, offset, length, kind, digest and folder."""
    spark = pages.sparkSession
    bound_batches(spark)
    folder = folder or f"{shared_dir(spark)}/doctide-warc-{uuid.uuid4().hex}"
    frame = pages.select(pages[id_col].alias("page"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    # The JVM's sha1 pairs the rows; the payloads themselves move at most once, compressed.
    told = frame.select("page", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    told = materialize(told, "digests")
    owners = told.groupBy("sha", "size").agg(F.max("page").alias("owner"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # A payload with very many copies is dealt out to several tasks.
    owners = owners.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = told.withColumn("part", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int")).join(owners, ["sha", "size", "part"])
    named = lambda c: F.coalesce(F.concat(F.lit("p"), F.col(c).cast("string")), F.lit(""))
    revisits = dealt.filter("page IS NULL OR page < owner").select(named("page").alias("r_name"), F.col("sha").alias("r_sha"), F.col("owner").cast("string").alias("owner")).distinct()

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "html", BLOCK_BYTES):
            payloads = [(h or "").encode() for h in block.column("html").to_pylist()]
            made = [_member(_headers("response", p, u, digest(b), len(b)), _HTTP + b) for p, u, b in zip(block.column("page").to_pylist(), block.column("url").to_pylist(), payloads, strict=True)]
            yield from pa.table({"page": block.column("page"), "name": block.column("name"), "url": block.column("url"), "sha": [hashlib.sha1(b).hexdigest() for b in payloads], "size": pa.array(map(len, payloads), pa.int64()), "member": pa.array(made, pa.binary())}).combine_chunks().to_batches()

    rows = frame.select(F.col("page").cast("string").alias("page"), named("page").alias("name"), "url", "html").mapInArrow(compress, "page string, name string, url string, sha string, size long, member binary")
    joined = rows.join(revisits, (F.col("name") == F.col("r_name")) & (F.col("sha") == F.col("r_sha")), "left")
    joined = joined.select("page", "url", "sha", "size", "owner", F.when(F.col("r_sha").isNull(), F.col("member")).alias("member"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            lines: list[dict] = []
            for r in batch.to_pylist():
                if out is not None and out.size >= FILE_BYTES:
                    out.close()
                    out, number = None, number + 1
                name = f"part-{part:06d}-{number:04d}.warc.gz"
                out = out or _Writer(folder, name)
                sha = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                kind = "response" if r["member"] is not None else "revisit"
                data = r["member"]
                if data is None:
                    extra = [("WARC-Refers-To", _name(r["owner"])), ("X-Refers-To-Page", r["owner"].translate(_LINE)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                    data = _member(_headers(kind, r["page"], r["url"], sha, r["size"]) + extra, _HTTP)
                lines.append({"key": url_key(r["url"]), "page": r["page"], "file": name, "offset": out.add(data), "length": len(data), "kind": kind, "digest": sha})
            yield pa.RecordBatch.from_pylist(lines, _LINES)
        if out is not None:
            out.close()

    captures = materialize(joined.mapInArrow(save, "key string, page string, file string, offset long, length long, kind string, digest string"), "captures")
    return captures.withColumn("folder", F.lit(folder))


def build_index(captures: DataFrame, path: str | None = None) -> str:
    """Sort capture lines by key into shards of compressed blocks, each with its directory; returns the index's path."""
    spark = captures.sparkSession
    path = path or f"{shared_dir(spark)}/doctide-cdx-{uuid.uuid4().hex}"
    line = F.to_json(F.struct("page", "folder", "file", "offset", "length", "kind", "digest"))
    # Range bounds come from the data's own keys; the file and offset break ties, so one busy URL or host is still dealt out.
    ordered = captures.select("key", "file", "offset", line.alias("line")).repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out = TaskContext.get().partitionId(), None
        entries: list[tuple[str, str, int, int]] = []
        held: list[tuple[str, str]] = []

        def block(lines: list[tuple[str, str]]) -> None:
            nonlocal out
            out = out or _Writer(f"{path}/blocks", f"shard-{shard:06d}")
            data = zlib.compress("\n".join(map(" ".join, lines)).encode())
            entries.append((lines[0][0], lines[-1][0], out.add(data), len(data)))

        for batch in batches:
            held += zip(batch.column("key").to_pylist(), batch.column("line").to_pylist(), strict=True)
            while len(held) >= BLOCK_LINES:
                block(held[:BLOCK_LINES])
                held = held[BLOCK_LINES:]
        if held:
            block(held)
        if out is not None:
            out.close()
            directory = _Writer(f"{path}/directory", f"shard-{shard:06d}")
            directory.add(zlib.compress("\n".join(f"{a} {b} {c} {d}" for a, b, c, d in entries).encode()))
            directory.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "first_key": entries[0][0], "last_key": entries[-1][1], "n_blocks": len(entries)}], pa.schema([("shard", pa.int32()), ("first_key", pa.string()), ("last_key", pa.string()), ("n_blocks", pa.int32())]))

    ordered.mapInArrow(pack, "shard int, first_key string, last_key string, n_blocks int").write.parquet(f"{path}/shards")
    return path


class Index:
    """Both levels of an index: the shards' bounds (a row a shard), directories and blocks read as they are needed, a few kept."""

    def __init__(self, path: str, shards: list[tuple[str, str, int]]) -> None:
        self.path, self.shards = path, shards
        self.firsts, self.lasts = [s[0] for s in shards], [s[1] for s in shards]
        self.directories: dict[int, list[list]] = {}
        self.files = Ranges()
        self.block: tuple[tuple[int, int], list[str], list[str]] = ((-1, -1), [], [])

    @classmethod
    def bounds(cls, spark: SparkSession, path: str) -> list[tuple[str, str, int]]:
        """First and last key of each shard in order; as many rows as the index job had tasks."""
        return sorted((r["first_key"], r["last_key"], r["shard"]) for r in spark.read.parquet(f"{path}/shards").collect())

    def _directory(self, shard: int) -> list[list]:
        if shard not in self.directories:
            if len(self.directories) >= 8:
                self.directories.pop(next(iter(self.directories)))
            fs, at = pyarrow.fs.FileSystem.from_uri(f"{self.path}/directory/shard-{shard:06d}")
            with fs.open_input_file(at) as source:
                rows = [x.split(" ") for x in zlib.decompress(source.read()).decode().split("\n")]
            self.directories[shard] = [[r[0] for r in rows], [r[1] for r in rows], [(int(r[2]), int(r[3])) for r in rows]]
        return self.directories[shard]

    def places(self, key: str) -> Iterator[tuple[int, int, int]]:
        """Shard, offset and length of every block that may hold the key."""
        for _, _, shard in self.shards[bisect_left(self.lasts, key) : bisect_right(self.firsts, key)]:
            firsts, lasts, spots = self._directory(shard)
            for offset, length in spots[bisect_left(lasts, key) : bisect_right(firsts, key)]:
                yield shard, offset, length

    def captures(self, shard: int, offset: int, length: int, key: str) -> Iterator[dict]:
        if self.block[0] != (shard, offset):
            data = zlib.decompress(self.files.read({"folder": f"{self.path}/blocks", "file": f"shard-{shard:06d}", "offset": offset, "length": length})).decode()
            lines = [x.split(" ", 1) for x in data.split("\n")]
            self.block = ((shard, offset), [x[0] for x in lines], [x[1] for x in lines])
        _, keys, lines_ = self.block
        for k in range(bisect_left(keys, key), bisect_right(keys, key)):
            yield json.loads(lines_[k])


class Ranges:
    """Range reads from files, the latest few kept open."""

    def __init__(self) -> None:
        self.open: dict[str, pa.NativeFile] = {}

    def read(self, place: dict) -> bytes:
        name = f"{place['folder']}/{place['file']}"
        if name not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            fs, at = pyarrow.fs.FileSystem.from_uri(name)
            self.open[name] = fs.open_input_file(at)
        return self.open[name].read_at(place["length"], place["offset"])


def lookup(spark: SparkSession, path: str, url: str) -> list[dict]:
    """The captures of one URL with their parsed headers and payloads."""
    index, key = Index(path, Index.bounds(spark, path)), url_key(url)
    found = []
    for shard, offset, length in index.places(key):
        for capture in index.captures(shard, offset, length, key):
            headers, payload = parse(index.files.read(capture))
            found.append(capture | {"headers": headers, "payload": payload})
    return found


#: Captures that are handed on at a time, of however few URLs they are.
READ_ROWS = 1024
_FOUND = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])


def fetch(spark: SparkSession, path: str, urls: DataFrame, url_col: str = "url", page_type: str = "bigint") -> DataFrame:
    """All captures of the given URLs, read back: page_id, url, payload size and digest, type and what it refers to.

    Every key is asked for once, so URLs that repeat, or differ only in what a key leaves out, give each capture once.
    """
    bound_batches(spark)
    shards = Index.bounds(spark, path)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": pa.array(list({url_key(u) for u in batch.column("url").to_pylist()}), pa.string())})

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(path, shards)
        for batch in batches:
            rows = [(*place, key) for key in batch.column("key").to_pylist() for place in index.places(key)]
            shard, offset, length, key = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int32()), "offset": pa.array(offset, pa.int64()), "length": pa.array(length, pa.int64()), "key": pa.array(key, pa.string())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(path, shards)
        for batch in batches:
            rows: list[dict] = []
            for asked in batch.to_pylist():
                for capture in index.captures(**asked):
                    if len(rows) == READ_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, _FOUND)
                        rows = []
                    h, payload = parse(index.files.read(capture))
                    sha, size = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                    if h["warc-type"] == "response":
                        size, found = len(payload), digest(payload)
                        if found != sha:
                            raise ValueError(f"payload of page {h.get('x-page-id')} doesn't match its digest")
                    rows.append({"page_id": h.get("x-page-id"), "url": h["warc-target-uri"], "payload_bytes": size, "payload_digest": sha, "record_type": h["warc-type"], "refers_to": h.get("x-refers-to-page")})
            yield pa.RecordBatch.from_pylist(rows, _FOUND)

    asked = urls.select(F.col(url_col).cast("string").alias("url")).mapInArrow(keys, "key string").distinct()
    # Keys in order read each shard's directory once; then each block is read once, wherever its keys come from.
    placed = asked.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(locate, "shard int, offset long, length long, key string")
    placed = placed.repartition("shard", "offset").sortWithinPartitions("shard", "offset", "key")
    out = placed.mapInArrow(read, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.withColumn("page_id", F.col("page_id").cast(page_type)).withColumn("refers_to", F.col("refers_to").cast(page_type))
