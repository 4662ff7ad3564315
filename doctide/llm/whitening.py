"""Whitening of embeddings from exact integer scatter that bit planes give.

Entries become whole numbers, ``floor(256 * entry)``. The fit list is each distinct vector once, written as a table. A
task takes its vectors in blocks; each dimension is shifted by its smallest value in the block, so that only bits that
vary are left, and each bit of it becomes a plane: one bit a vector, packed into 64-bit words. The cross-product of two
dimensions is the sum over pairs of their planes of the popcount of their conjunction, weighted by both planes' powers
of two; shifts are undone by the dimensions' sums. All of that is exact, of any width up to 64 bits. Tasks send one row a
pair of dimensions, which Spark sums as decimals; the driver gets one row a pair, so its memory goes with the square of
the dimensions and not with the rows. The covariance is centred in whole numbers before it becomes double, and split by
``eigh``. A second pass over the fit list measures how far the whitened vectors are from the identity.

Vectors that are null or hold null, NaN or infinite entries are left out. Of vectors of several lengths, those of the
most frequent length stay (the longest of several such); empty vectors have no components and so no rows. Entries beyond
the long range after scaling take its end. Repeated rows count once in the fit and give equal rows, an empty table gives
none. Fewer dimensions than components give as many. A component without variance (its eigenvalue within 1e-12 of the
trace, as for a single distinct vector) has null ``whitened`` and isn't part of ``identity_error``; ``explained`` is null
if nothing varies. Equal eigenvalues keep the order that ``eigh`` gives. ``deviation`` is null where a long can't hold it.
Only the id and vector columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Vectors that are cut into bit planes at a time.
BLOCK_ROWS = 4096
#: Entries are scaled by this before they are floored.
SCALE = 256
#: An eigenvalue of this share of the trace or less counts as no variance.
NO_VARIANCE = 1e-12
LONG = 1 << 63
#: Bits of the lower part of a number that is summed in two.
HALF = 60


def whole(vector: Column) -> Column:
    """The vector as whole numbers; null if it is null or holds entries that are null or not finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda v: F.floor(v.cast("double") * SCALE)))


def usable(vectors: DataFrame, vector_column: str = "embedding") -> DataFrame:
    """All columns of vectors that can be whitened, with ``x``, the whole numbers; of one length."""
    rows = vectors.withColumn("x", whole(F.col(vector_column))).filter("x IS NOT NULL")
    lengths = rows.groupBy(F.size("x").alias("size")).count()
    longest = lengths.orderBy(F.desc("count"), F.desc("size")).limit(1).select(F.col("size").alias("__size"))
    return rows.join(F.broadcast(longest), F.size("x") == F.col("__size")).drop("__size").filter(F.size("x") > 0)  # one row is broadcast


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def planes(y: np.ndarray, widths: list[int]) -> np.ndarray:
    """Bit planes of the columns of unsigned numbers, lowest bit first, as rows of 64-bit words."""
    n = len(y)
    out = np.zeros((sum(widths), -(-n // 64) * 8), np.uint8)
    at = 0
    for dim, width in enumerate(widths):
        bits = (y[:, dim][None, :] >> np.arange(width, dtype=np.uint64)[:, None]) & np.uint64(1)
        out[at : at + width, : -(-n // 8)] = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little")
        at += width
    return out.view(np.uint64)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products of the columns of whole numbers, as Python integers."""
    n, dims = x.shape
    low = x.min(axis=0)
    y = x.astype(np.uint64) - low.astype(np.uint64)  # right modulo 2 ** 64, hence right
    widths = [int(v).bit_length() for v in y.max(axis=0)]
    p = planes(y, widths)
    both = np.zeros((len(p), len(p)), np.int64)
    for i in range(len(p)):
        both[i, i:] = both[i:, i] = np.bitwise_count(p[i] & p[i:]).sum(axis=1, dtype=np.int64)
    ends = np.cumsum([0, *widths])
    spans = [slice(s, e) for s, e in zip(ends[:-1], ends[1:], strict=True)]
    kind = object if max(widths) * 2 + n.bit_length() > 62 else np.int64
    weight = np.array([1 << b for w in widths for b in range(w)], kind)
    cross = np.zeros((dims, dims), object)
    for dim, span in enumerate(spans):
        row = weight[span] @ both[span].astype(kind) * weight
        cross[dim] = [int(row[other].sum()) for other in spans]
    ones = np.diagonal(both) * weight
    sums = np.array([int(ones[span].sum()) for span in spans], object)
    shift = low.astype(object)
    cross = cross + sums[:, None] * shift[None, :] + shift[:, None] * sums[None, :] + n * shift[:, None] * shift[None, :]
    return sums + n * shift, cross


def sums(fit: DataFrame) -> DataFrame:
    """i, j, high, low over the column ``x``: cross-products for i <= j, sums at j = -1, and the number of rows at i = j = -1.

    A number is high * 2 ** HALF + low, so that no sum leaves the 38 digits of a decimal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, cross = 0, 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                s, c = scatter(_matrix(batch.column("x").slice(start, BLOCK_ROWS)))
                n, total, cross = n + min(BLOCK_ROWS, batch.num_rows - start), total + s, cross + c
        if n:
            a, b = np.triu_indices(len(total))
            dims = np.arange(len(total))
            i, j = np.r_[-1, dims, a], np.r_[-1, np.full(len(total), -1), b]
            made = [int(v) for v in [n, *total, *cross[a, b]]]
            high, low = [str(v >> HALF) for v in made], [v & ((1 << HALF) - 1) for v in made]
            yield from pa.table({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "high": high, "low": pa.array(low, pa.int64())}).to_batches()

    rows = fit.select("x").mapInArrow(run, "i int, j int, high string, low long")
    total = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    return rows.groupBy("i", "j").agg(*total)


@dataclass
class Whitener:
    """n rows of sums ``total``; ``vectors`` by column with their ``values``, falling; ``trace`` of the covariance."""

    n: int
    total: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def varies(self) -> np.ndarray:
        return self.values > NO_VARIANCE * self.trace if self.trace > 0 else np.zeros(len(self.values), bool)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Centred, projected and scaled rows; NaN for components without variance."""
        mean = np.array([t / self.n for t in self.total])
        scale = np.where(self.varies, np.sqrt(np.where(self.varies, self.values, 1.0)), np.nan)
        return (x.astype(np.float64) - mean) @ self.vectors / scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) squared, exact."""
        span = max(abs(self.n * int(v) - t) for limit in (x.min(axis=0), x.max(axis=0)) for v, t in zip(limit, self.total, strict=True))
        fits = span * span * x.shape[1] < LONG and self.n * int(np.abs(x).max()) < LONG and max(map(abs, self.total)) < LONG
        d = x * np.int64(self.n) - np.array(self.total, np.int64) if fits else x.astype(object) * self.n - np.array(self.total, object)
        return [v if v < LONG else None for v in map(int, (d * d).sum(axis=1))]


def fit(distinct: DataFrame, components: int = 4) -> Whitener | None:
    """The whitener of distinct vectors ``x``; None if there are none."""
    found = {(r["i"], r["j"]): (int(r["high"]) << HALF) + int(r["low"]) for r in sums(distinct).collect()}  # a row a pair of dimensions
    if not found:
        return None
    n = found[-1, -1]
    dims = 1 + max(i for i, _ in found)
    total = [found[i, -1] for i in range(dims)]
    covariance = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            covariance[i, j] = covariance[j, i] = (n * found[i, j] - total[i] * total[j]) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    made = Whitener(n, total, vectors, values[order], float(np.trace(covariance)))
    made.identity_error = _identity_error(distinct, made)
    return made


def _identity_error(distinct: DataFrame, made: Whitener) -> float | None:
    """Largest entry of the whitened vectors' covariance less the identity; whitening centres them before they are multiplied."""
    k = int(made.varies.sum())
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = made.project(_matrix(batch.column("x")))[:, :k]
            first, second = first + w.sum(axis=0), second + w.T @ w
        yield pa.record_batch({"at": pa.array(range(k + k * k), pa.int32()), "v": pa.array(np.r_[first, second.ravel()])})

    rows = distinct.select("x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    v = np.array([r["v"] for r in rows]) / made.n
    return float(np.abs(v[k:].reshape(k, k) - np.outer(v[:k], v[:k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 4) -> DataFrame:
    """A row for each usable vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.write(usable(vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v")), "v").select("id", "x"), "vectors")
    distinct = scratch.write(rows.select("x").distinct(), "distinct")
    made = fit(distinct, components)
    scratch.drop(distinct)
    kind = dict(vectors.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(made.values)
        explained = [float(v) / made.trace if made.trace > 0 else None for v in made.values]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            w = pa.array(made.project(x).ravel(), from_pandas=True)
            again = np.repeat(np.arange(len(x)), k)
            new = {"id": batch.column("id").take(pa.array(again)), "component": pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), "n": pa.array(np.full(len(again), made.n))}
            new |= {"deviation": pa.array(made.deviation(x), pa.int64()).take(pa.array(again)), "whitened": w, "explained": pa.array(explained * len(x), pa.float64())}
            yield pa.record_batch(new | {"identity_error": pa.array([made.identity_error] * len(again), pa.float64())})

    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if made is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_column)
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
