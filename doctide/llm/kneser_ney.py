"""Quality by an interpolated modified Kneser-Ney model of character 4-grams, trained on trusted text.

Symbols are UTF-16 code units, so a 4-gram is one 64-bit number, its context and its suffix are shifts and masks, and
all counts are Spark aggregations. Trusted text is every document labelled good. Counts of 4-grams are summed inside
tasks before they are shuffled; lower orders count the distinct continuations of the order above.

Scoring is a sharded count join: documents travel in compressed chunks, each asks for its distinct 4-grams, the
distinct requests of all chunks are joined once with the count tables, and each chunk gets its own list of
log-probabilities back. A document is rejected if its log-perplexity lies above an upper quantile of its language's
trusted documents by more than a slack that shrinks with its length, as very short clean texts scatter widely. As texts
that a model was trained on score better than new ones, the quantile is that of held-out documents under a model of the
other trusted ones, or that of all under the whole model if it is higher.

Null and empty texts are rejected and have no perplexity; a language (or null) without trusted documents takes the
threshold of all languages; without any trusted document nothing is rejected but empty text. A loss that equals its
limit is kept. Repeated rows count as often as they come and give equal rows; rows of a null id are scored and never
trusted. A very long text makes a chunk of its own and is scored in whole. An empty table gives no rows. Only doc_id,
lang and text, and the labels' doc_id and quality, are read; other columns are free to have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, bound_batches, materialize

ORDER = 4
BLOCK_BYTES = 1 << 20
#: Bytes of text in a chunk; a longer document makes a chunk of its own.
CHUNK_BYTES = 16 << 20
#: Ids of trusted documents that are sent to every executor, at most; beyond, they are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: One trusted document in so many is held out of a second model, whose losses of them tell how unseen clean text scores.
HELD_OUT = 4
#: A language's limit of log-perplexity is this quantile of its held-out documents; a text of n symbols may exceed it by SLACK / n.
#: Chosen on the labelled documents of sf0.1, see the README.
UPPER, SLACK = 0.98, 20.0
_PAD, _END = "\x02" * (ORDER - 1), "\x03"


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """4-grams of all texts in order as 64-bit numbers, and how many each text has (its code units and an end mark)."""
    units = [(_PAD + t + _END).encode("utf-16-le", "surrogatepass") for t in texts]
    lengths = np.array([len(u) // 2 for u in units], np.int64)
    q = np.frombuffer(b"".join(units), np.uint16).astype(np.uint64)
    n = len(q) - ORDER + 1
    code = np.zeros(n, np.uint64)
    for i in range(ORDER):
        code <<= np.uint64(16)
        code |= q[i : n + i]
    inside = np.ones(len(q), bool)
    ends = np.cumsum(lengths)
    for i in range(1, ORDER):
        inside[ends - i] = False
    return code[inside[:n]], lengths - ORDER + 1


def _distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ordered = np.sort(code)
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[first], np.diff(np.r_[first, len(ordered)])


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code = np.concatenate([p[0] for p in parts])
    count = np.concatenate([p[1] for p in parts])
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[first], np.add.reduceat(count[order], first)


def _gathered(lists: Iterator[list[str]], limit: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct 4-grams with counts, over so many texts that at most ``limit`` are held; repeated across what is yielded."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for texts in lists:
        code, _ = grams(texts)
        parts.append(_distinct(code))
        if sum(len(p[0]) for p in parts) > limit:
            parts = [_merge(parts)]
            if len(parts[0][0]) > limit // 2:
                yield parts.pop()
    if parts:
        yield _merge(parts)


def count_grams(trusted: DataFrame) -> DataFrame:
    """gram, c over the texts of ``trusted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = (b.column("text").drop_null().to_pylist() for b in blocks(batches, "text", BLOCK_BYTES))
        for code, count in _gathered(x for x in lists if x):
            yield from pa.table({"gram": code.view(np.int64), "c": count}).to_batches(max_chunksize=1 << 16)

    return trusted.select("text").mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


class Model:
    """For each order the discounted shares of seen grams and the back-off weights of contexts, as tables."""

    def __init__(self, counts: DataFrame) -> None:
        self.shares: dict[int, DataFrame] = {}
        self.backs: dict[int, DataFrame] = {}
        level = materialize(counts, "grams4")
        for order in range(ORDER, 0, -1):
            d = _discounts(level)
            cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
            context = F.shiftrightunsigned("gram", 16) if order > 1 else F.lit(0).cast("long")
            stats = level.groupBy(context.alias("context")).agg(F.sum("c").alias("total"), F.sum(cut).alias("held"))
            stats = materialize(stats.select("context", "total", (F.col("held") / F.col("total")).alias("back")), f"contexts{order}")
            joined = level.withColumn("context", context).join(stats, "context")
            self.shares[order] = materialize(joined.select(F.col("gram").alias(f"gram{order}"), ((F.col("c") - cut) / F.col("total")).alias(f"share{order}")), f"shares{order}")
            self.backs[order] = stats.select(F.col("context").alias(f"context{order}"), F.col("back").alias(f"back{order}"))
            if order > 1:
                mask = (1 << 16 * (order - 1)) - 1
                level = materialize(level.groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count("*").alias("c")), f"grams{order - 1}")
        self.symbols = level.count() + 1
        first = self.backs[1].first()
        self.floor = (first["back1"] if first else 1.0) / self.symbols

    def log_probability(self, requests: DataFrame) -> DataFrame:
        """gram and logp for distinct requested grams."""
        out = requests.select("gram")
        for order in range(1, ORDER + 1):
            mask = (1 << 16 * order) - 1
            own = F.col("gram").bitwiseAND(F.lit(mask)) if order < ORDER else F.col("gram")
            out = out.withColumn(f"gram{order}", own).join(self.shares[order], f"gram{order}", "left")
            if order > 1:
                out = out.withColumn(f"context{order}", F.shiftrightunsigned(f"gram{order}", 16)).join(self.backs[order], f"context{order}", "left")
        p: Column = F.coalesce("share1", F.lit(0.0)) + F.lit(self.floor)
        for order in range(2, ORDER + 1):
            p = F.coalesce(f"share{order}", F.lit(0.0)) + F.coalesce(f"back{order}", F.lit(1.0)) * p
        return out.select("gram", F.log(p).alias("logp"))


def _discounts(level: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts from the counts of counts; where those are too few, three quarters."""
    n = level.agg(*[F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (n[f"n{k}"] or 0 for k in (1, 2, 3, 4))
    if not (n1 and n2):
        return [0.75, 0.75, 0.75]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.75]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
    """Chunks of a partition with a key that tells place and content, so that two passes over one input agree."""
    part = TaskContext.get().partitionId()
    for n, block in enumerate(blocks(batches, "text", CHUNK_BYTES)):
        block = block.combine_chunks()
        told = xxhash.xxh64_hexdigest(repr((block.column("doc_id").to_pylist(), [len(t or "") for t in block.column("text").to_pylist()])))
        yield f"{part}:{n}:{told}", block


def _pieces(block: pa.Table) -> Iterator[pa.Table]:
    yield from blocks(iter(block.to_batches()), "text", BLOCK_BYTES)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, told, n_symbols, logp (natural) for rows of (doc_id, lang, told, text)."""
    frame = docs.select("doc_id", "lang", "told", F.col("text").cast("string").alias("text"))
    id_type = frame.schema["doc_id"].dataType.simpleString()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block in _chunks(batches):
            seen = [c for c, _ in _gathered([t or "" for t in p.column("text").to_pylist()] for p in _pieces(block))]
            code = seen[0] if len(seen) == 1 else _distinct(np.concatenate(seen))[0]
            for at in range(0, len(code), 1 << 16):
                part = code[at : at + (1 << 16)].view(np.int64)
                yield from pa.table({"key": pa.array([key], pa.string()).take(pa.array(np.zeros(len(part), np.int32))), "gram": part}).to_batches()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block in _chunks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema) as out:
                out.write_table(block)
            yield pa.RecordBatch.from_pylist([{"key": key, "chunk": zstandard.ZstdCompressor(level=3).compress(sink.getvalue())}], pa.schema([("key", pa.string()), ("chunk", pa.binary())]))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = batch.column("found").slice(i, 1).flatten()
                if not batch.column("found")[i].is_valid:
                    raise ValueError("a chunk changed between two passes over the documents; write them to a table first")
                code, logp = (found.field(k).to_numpy(zero_copy_only=False) for k in ("gram", "logp"))
                code = code.view(np.uint64)
                order = np.argsort(code)
                code, logp = code[order], logp[order]
                with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(batch.column("chunk")[i].as_py())) as opened:
                    block = opened.read_all()
                for piece in _pieces(block):
                    own, counts = grams([t or "" for t in piece.column("text").to_pylist()])
                    sums = np.add.reduceat(logp[np.searchsorted(code, own)], np.cumsum(counts) - counts)
                    yield from pa.table({"doc_id": piece.column("doc_id"), "lang": piece.column("lang"), "told": piece.column("told"), "n_symbols": counts, "logp": sums}).combine_chunks().to_batches()

    asked = frame.mapInArrow(ask, "key string, gram long")
    known = materialize(model.log_probability(asked.select("gram").distinct()), "logp")
    told = asked.join(known, "gram").groupBy("key").agg(F.collect_list(F.struct("gram", "logp")).alias("found"))
    chunks = frame.mapInArrow(pack, "key string, chunk binary")
    return chunks.join(told, "key", "left").mapInArrow(answer, f"doc_id {id_type}, lang string, told long, n_symbols long, logp double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold (of perplexity), kept and text_hash (xxhash64) for every document."""
    bound_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    frame = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.xxhash64(text).alias("told"), text.alias("text"))
    good = materialize(labels.filter("quality = 1").select(F.col("doc_id").alias("trusted_id")).filter("trusted_id IS NOT NULL").distinct(), "trusted")
    side = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    trusted = frame.join(side, F.col("doc_id") == F.col("trusted_id"), "left_semi")
    out = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    part = materialize(count_grams(trusted.filter(~out)), "part")
    model = Model(part.unionByName(count_grams(trusted.filter(out))).groupBy("gram").agg(F.sum("c").alias("c")))
    loss = (-F.col("logp") / F.col("n_symbols")).alias("loss")
    scores = materialize(score(frame, model).select("*", loss), "scores")
    held = materialize(score(materialize(trusted.filter(out), "held"), Model(part)).select("*", loss), "held-scores")
    seen = scores.join(side, F.col("doc_id") == F.col("trusted_id"), "left_semi")
    both = held.withColumn("new", F.lit(True)).unionByName(seen.withColumn("new", F.lit(False))).filter("n_symbols > 1")
    marks = both.groupBy("lang", "new").agg(F.percentile_approx("loss", F.lit(UPPER), 10000).alias("limit"))
    limits = materialize(marks.groupBy("lang").agg(F.max("limit").alias("own")).filter("lang IS NOT NULL").withColumnRenamed("lang", "of"), "limits")
    overall = both.groupBy("new").agg(F.percentile_approx("loss", F.lit(UPPER), 10000).alias("limit")).agg(F.max("limit").alias("limit")).first()["limit"]
    scores = scores.join(limits, F.col("lang") == F.col("of"), "left")
    top = F.coalesce("own", F.lit(overall if overall is not None else math.inf).cast("double"))
    top = top + F.lit(SLACK) / F.col("n_symbols")
    empty = F.col("n_symbols") <= 1
    return scores.select(
        "doc_id", "lang", (F.col("n_symbols") - 1).alias("n_symbols"), F.when(~empty, F.exp("loss")).alias("perplexity"), F.exp(top).alias("threshold"), (~empty & (F.col("loss") <= top)).alias("kept"), F.col("told").alias("text_hash"),
    )
