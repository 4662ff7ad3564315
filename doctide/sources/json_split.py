"""Top-level JSON objects of files that are one array, or objects one after another, read by many tasks a file.

Spark reads a file's byte ranges as records that end at opening braces, whatever the file's size and system. What stands
in a range can't be told without knowing how it is entered: inside a string or not, and how many objects deep. So each
range is first summed up as a function from entry to exit for both cases (a shift of the depth that stops at zero, and
whether quotes change sides); the functions of a file's ranges, a row each, are applied one after another; and each range
is then cut where the depth returns to zero, by the task that reads it: entries, a small row a range, are sent to all
tasks, and records are taken as they come. Objects that cross ranges come as parts, which are joined by the range that
they begin in. What a task holds goes with an object's own size, not with that of ranges or files.

A backslash takes the next character with it, inside strings and out. Between objects an array holds ``[`` first, ``]``
last and single commas; concatenated objects may have a comma or nothing; white space doesn't matter. Any other text
comes as broken, in parts that begin at a brace; a missing bracket or comma comes as an empty broken text. An object
without an end is broken from its beginning to the end of the file, a part a range. Whatever isn't JSON or isn't UTF-8 is
broken. An empty file gives nothing; one of white space has no objects, which for an array is broken. A brace that is the
last byte of a compressed file isn't seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sinks

_TOKEN = re.compile(rb'\\.|"|\}', re.S)
_PRESSED = re.compile(r"\.(gz|bz2|deflate|lz4|snappy|xz|zst)$")
_ESCAPE = re.compile(rb"\\.", re.S)
_SUMMARY = "path string, block long, rows long, bytes long, size long, flip boolean, " + ", ".join(f"{c}{e} long" for e in (0, 1) for c in ("shift", "least", "low"))
_ENTRY = "path string, block long, in_string boolean, depth long, began long, unclosed long, last boolean, cut boolean"
_FOUND = "raw string, broken boolean, file long, began long, block long"
#: What a record is told of its range, as ``_Cutter`` takes it.
_KNOWN = ("file", "block", "in_string", "depth", "began", "unclosed", "last", "cut")
#: Cut objects are handed on in pieces of so many rows or characters.
_PIECE_ROWS, _PIECE_CHARS = 1024, 4_000_000


def records(spark: SparkSession, path: str) -> DataFrame:
    """path, size and block (where the range begins) of each record with its bytes; all but a file's first follow an opening brace."""
    text = spark.read.option("lineSep", "{").text(path)
    where = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block")]
    return text.select(*where, F.col("value").cast("binary").alias("body"))


def _sum_up(path: str, block: int, size: int, bodies: Iterator[bytes]) -> dict:
    """A range as a function: for an entry outside (0) or inside (1) a string, the depth x becomes max(x + shift, least), and is at most x + low on the way."""
    flip, rows, total = 0, 0, 0
    shift, least, low = [0, 0], [0, 0], [0, 0]
    for body in bodies:
        opens = rows > 0 or block > 0
        parts = (_ESCAPE.sub(b"", body) if b"\\" in body else body).split(b'"')
        closes = [sum(p.count(b"}") for p in parts[side::2]) for side in (0, 1)]
        for entry in (0, 1):
            inside = entry ^ flip
            by = (opens and not inside) - closes[inside]
            shift[entry] += by
            least[entry] = max(least[entry] + by, 0)
            low[entry] = min(low[entry], shift[entry])
        flip ^= (len(parts) - 1) & 1
        rows, total = rows + 1, total + len(body) + 1
    return {"path": path, "block": block, "rows": rows, "bytes": total, "size": size, "flip": bool(flip)} | {f"{n}{e}": v[e] for e in (0, 1) for n, v in (("shift", shift), ("least", least), ("low", low))}


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("path", "block", "size", "body")), strict=True))
    for (path, block, size), group in groupby(rows, key=lambda r: r[:3]):
        yield pa.RecordBatch.from_pylist([_sum_up(path, block, size, (r[3] for r in group))])


def _entries(ranges: pd.DataFrame) -> pd.DataFrame:
    """How each range of a file is entered; a row a range."""
    ranges = ranges.sort_values("block")
    inside, depth, began, out = 0, 0, -1, []
    for r in ranges.itertuples():
        out.append([r.path, r.block, bool(inside), depth, began])
        shift, least, low = ((r.shift0, r.least0, r.low0), (r.shift1, r.least1, r.low1))[inside]
        if depth + low <= 0:
            began = r.block  # whatever is open at the end began here
        depth = max(depth + shift, least)
        began = began if depth else -1
        inside ^= r.flip
    missing = ranges["size"].iloc[0] - ranges["bytes"].sum() + 1
    frame = pd.DataFrame(out, columns=["path", "block", "in_string", "depth", "began"])
    return frame.assign(unclosed=began, last=frame["block"] == frame["block"].max(), cut=missing in (1, 4) and not _PRESSED.search(ranges["path"].iloc[0]))  # a final brace gives no record, a byte order mark at the start is skipped


class _Cutter:
    """Cuts one range into objects, parts of objects and broken texts."""

    def __init__(self, layout: str, file: int, block: int, in_string: bool, depth: int, began: int, unclosed: int, last: bool, cut: bool) -> None:
        self.layout, self.file, self.block, self.unclosed, self.last, self.cut_off = layout, file, block, unclosed, last, cut
        self.in_string, self.depth, self.began = in_string, depth, began
        self.held: list[bytes] = []
        self.out: list[tuple[str, bool, int | None, int | None, int | None]] = []

    def _put(self, text: bytes, broken: bool = False, began: int | None = None) -> None:
        try:
            raw = text.decode()
        except UnicodeDecodeError:
            raw, broken = text.decode("utf-8", "replace"), True
        self.out.append((raw, broken, None if began is None else self.file, began, None if began is None else self.block))

    def _object(self) -> None:
        text = b"".join(self.held)
        self.held = []
        self._put(text, False, self.began if self.began != self.block else None)

    def _between(self, text: bytes, first: bool, final: bool) -> None:
        said = text.strip()
        if self.layout == "array":
            fine = re.fullmatch(rb"\[\s*\]", said) if first and final else said == (b"[" if first else b"]" if final else b",")
        else:
            fine = said in ((b"",) if first or final else (b"", b","))
        if not fine:
            self._put(said, True)

    def cut(self, bodies: Iterator[bytes]) -> Iterator[tuple]:
        """What the range's records make, handed on record by record."""
        n, after = 0, next(bodies, None)
        while after is not None:
            body, after = after, next(bodies, None)
            first, final = self.block == 0 and n == 0, self.last and not self.cut_off and after is None
            n += 1
            lead = b"" if first else b"{"
            between = 0 if not self.depth else None  # where text between objects begins
            if lead and not self.in_string:
                if not self.depth:
                    self.began, between = self.block, None
                self.depth += 1
            end = 0
            for token in _TOKEN.finditer(body):
                if token[0] == b'"':
                    self.in_string = not self.in_string
                elif token[0] == b"}" and not self.in_string and self.depth:
                    self.depth -= 1
                    if not self.depth:
                        end = between = token.end()
                        self.held.append(lead + body[:end])
                        self._object()
                        lead = b""
            if between is not None:
                self._between(lead + body[between:], first, final)
            elif self.depth:
                self.held.append(lead + body)
            yield from self.out
            self.out.clear()
        if self.held:
            text = b"".join(self.held)
            if self.began == self.unclosed:
                self._put(text, True)
            else:
                self._put(text, False, self.began)
        if self.last and self.cut_off:
            self._put(b"{", True)
        yield from self.out


def _pieces(layout: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranges of a task, one after another, cut as their records come."""

    def records_of() -> Iterator[tuple[int, int, bytes, pa.RecordBatch, int]]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("file", "block", "body"))
            for i, (file, block, body) in enumerate(zip(*columns, strict=True)):
                yield file, block, body, batch, i

    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["raw", "broken", "file", "began", "block"])
    out, chars = [], 0
    for _, group in groupby(records_of(), key=lambda r: r[:2]):
        _, _, body, batch, at = next(group)
        known = {c: batch.column(c)[at].as_py() for c in _KNOWN}
        for row in _Cutter(layout, **known).cut(chain([body], (r[2] for r in group))):
            out.append(row)
            chars += len(row[0])
            if len(out) >= _PIECE_ROWS or chars >= _PIECE_CHARS:
                yield made(out)
                out, chars = [], 0
    if out:
        yield made(out)


def split_objects(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """``raw`` and ``broken``: each top-level object, and what can't be read."""
    found = records(spark, path)
    entries = found.mapInArrow(_summaries, _SUMMARY).groupBy("path").applyInPandas(_entries, _ENTRY)
    numbered = entries.withColumn("file", F.monotonically_increasing_id()).withColumn("file", F.min("file").over(Window.partitionBy("path")))
    told = F.broadcast(sinks.written(numbered, "ranges"))  # a row a range
    # Records stay in the task that reads them and in their order.
    pieces = found.join(told, ["path", "block"]).select(*_KNOWN, "body").mapInArrow(lambda batches: _pieces(layout, batches), _FOUND)
    parts = pieces.filter("file IS NOT NULL").groupBy("file", "began")  # the parts of one object
    whole = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "raw"))), lambda p: p["raw"]), "").alias("raw"), F.max("broken").alias("broken"))
    every = pieces.filter("file IS NULL").select("raw", "broken").unionByName(whole.select("raw", "broken"))
    return every.select("raw", (F.col("broken") | F.try_parse_json("raw").isNull()).alias("broken"))
