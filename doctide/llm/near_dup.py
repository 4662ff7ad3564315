"""Near-duplicates by bottom-k sketches of one hash function.

A document's set holds its distinct word shingles, hashed to 64 bits. Documents with the same set are one node, told
by a 64-bit sum over the set. A sketch holds a set's ``K`` smallest hashes. An inverted list for each value of the
sketches' prefixes yields candidates. Values that a sample of the sketches holds often come last in the order, which
keeps common lines and passages out of the lists; the sample (``HINTS`` values at most) sets only the order. A prefix
is as long as it takes for similar sets to meet: where few values of a sketch are frequent, its ``NEAR`` smallest
others (a pair of similarity 0.75 shares none of them with a chance below 1e-7); else, by the sketch values that
similar sets share at least (``_least_shared``), all but so many. Rounds then link:

* each list's members are paired with one of them: first the one that most lists hold, which is the original where
  others were made from it, then, as long as more than ``ENOUGH`` of the pairs link, a random one of another component,
  so that families join without all pairs;
* a last round takes the nodes whose lists hold several components still. Their full sets, rarest values first, meet in
  lists of their exact prefixes, and two of different components are paired where the places of a common value leave
  enough values behind them. A member far from its family's original holds more own values than its prefix is long, so
  it meets nobody; members of a list's largest component aren't paired with each other;
* candidates that the union of both sketches rules out are dropped, the others' full sets are compared exactly.

No list, bucket or partner is capped; long lists and nodes that many pairs name are dealt out to several tasks.

Null or wordless text, of any number of rows, has an empty set and stays alone; fewer words than a shingle make one
shingle of the whole sequence. Ties and repeated rows follow the smallest id; a null id counts as larger than any, and
a component of null ids alone has a null component_id. Very long texts are hashed in pieces of ``PIECE`` bytes. An
empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, blocks, bound_batches, utf8

SHINGLE = 5
K = 128
#: Sketch values that similar sets of more than WHOLE shingles share at least.
LEAST, WHOLE = 70, 96
#: Smallest infrequent values that make a prefix where at most one in FEW sketch values is frequent.
NEAR, FEW = 16, 8
#: Of the K smallest values of the union, how many both sets hold at least (chance below 1e-6 that similar sets hold fewer).
UNION_LEAST = 70
#: Values whose frequency orders the prefixes, at most, and the share of documents they are counted on.
HINTS, HINT_SHARE = 200_000, 16
BLOCK_BYTES = 512 << 10
#: Bytes of text that are hashed at a time; a longer word is a piece of its own.
PIECE = 1 << 20
PAIR_ROWS = 64
#: Share of a random round's pairs that must link for another one to follow; what is left is the last round's.
ENOUGH = 0.1
#: List entries, or pairs of one node, that meet in one task; more are dealt out by a salt.
SPLIT = 512
#: Parts that the copies of a set are dealt out to when components are told to them.
SALTS = 16
#: Nodes with more than SPLIT pairs up to which they are broadcast; beyond, they are joined by shuffle.
HOT_NODES = 200_000
#: Bytes of the documents from which a Bloom filter pays, and of the nodes named up to which one is built.
BLOOM = {"enabled": "true", "applicationSideScanSizeThreshold": "16m", "creationSideThreshold": "1g"}
#: Size up to which Spark broadcasts a join's side by itself.
BROADCAST = "spark.sql.autoBroadcastJoinThreshold"

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Capitals to small letters, separators to line feeds.
_FLAT = bytes(10 if c in (32, 9, 10, 11, 12, 13) else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    one = lambda x: np.multiply.accumulate(np.r_[_U(1), np.full(size - 1, x, np.uint64)])
    return one(_U(_BASE)), one(_U(pow(_BASE, -1, 1 << 64)))


def _piece_hashes(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a piece that begins and ends at separators, and where each word starts."""
    raw = np.frombuffer(piece, np.uint8)
    up, down = _powers(1 << max(16, len(raw).bit_length()))
    solid = raw != 10
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    bounds = np.r_[0, edge] if len(solid) and solid[0] else edge
    starts, ends = bounds[::2], bounds[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + _U(1)) * up[: len(raw)], out=total[1:])
    return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    raw = b"\n".join(texts).translate(_FLAT) + b"\n"
    hashes, places, at = [], [], 0
    while at < len(raw):
        end = raw.find(b"\n", min(at + PIECE, len(raw)) - 1) + 1
        found, starts = _piece_hashes(raw[at:end])
        hashes.append(found)
        places.append(starts + at)
        at = end
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return np.concatenate(hashes), np.diff(np.r_[0, np.searchsorted(np.concatenate(places), text_ends)])


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    flat, counts = _word_hashes(texts)
    starts = np.cumsum(counts) - counts
    code = np.zeros(max(len(flat) - shingle + 1, 0), np.uint64)
    for i in range(shingle):
        code = _mix(code + _U(i + 1)) + flat[i : len(code) + i]
    code = _mix(code)
    out = []
    for s, n in zip(starts.tolist(), counts.tolist(), strict=True):
        if n >= shingle:
            x = np.sort(code[s : s + n - shingle + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif n:
            whole = np.zeros(1, np.uint64)
            for i in range(n):
                whole = _mix(whole + _U(i + 1)) + flat[s + i : s + i + 1]
            out.append(_mix(whole + _U(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _arrays(values: list[np.ndarray]) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.view(np.int64)))


def measured(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, told, n_shingles, node (a sum that tells the set), the sketch, smallest value first, and the text, of (doc_id, told, text).

    The text comes as zstandard bytes, for the road, once for each set that a task meets; other rows hold null there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, shown = zstandard.ZstdCompressor(level=1), set()
        for block in blocks(batches, "text", BLOCK_BYTES):
            texts = utf8(block, "text")
            sets = shingle_sets(texts, shingle)
            sizes, nodes, pressed = [len(x) for x in sets], _nodes(sets), []
            for text, size, node in zip(texts, sizes, nodes.tolist(), strict=True):
                pressed.append(job.compress(text) if size and node not in shown else None)
                shown.add(node)
            yield from pa.table({"doc_id": block.column("doc_id"), "told": block.column("told"), "n_shingles": pa.array(sizes, pa.int64()), "node": nodes, "sketch": _arrays([x[:K] for x in sets]), "pressed": pa.array(pressed, pa.binary())}).combine_chunks().to_batches()

    return docs.mapInArrow(run, "doc_id long, told long, n_shingles long, node long, sketch array<long>, pressed binary")


def _nodes(sets: list[np.ndarray]) -> np.ndarray:
    sums = np.array([_mix(x + _U(0x1234567)).sum(dtype=np.uint64) for x in sets], np.uint64)
    return _mix(sums + np.array([len(x) for x in sets], np.uint64)).view(np.int64)


def _least_shared(n: np.ndarray) -> np.ndarray:
    """For sets of n shingles, the sketch values that a similar set shares at least."""
    return np.where(n <= WHOLE, -(-n * 3 // 4), LEAST)


def _high(values: np.ndarray) -> np.ndarray:
    """The hashes' upper halves as integers of the same order."""
    return ((values >> _U(32)).astype(np.uint32) ^ np.uint32(1 << 31)).view(np.int32)


def _ranked(flat: np.ndarray, known: np.ndarray, by_value: np.ndarray) -> np.ndarray:
    """The place of each value among the frequent ones, from 1; 0 for others."""
    if not len(known):
        return np.zeros(len(flat), np.int64)
    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    return np.where(known[at] == flat, by_value[at] + 1, 0)


def prefixes(told: DataFrame, hints: np.ndarray) -> DataFrame:
    """node, size, prefix and ranked: the upper halves of the whole sketch, those of the prefix first.

    ``told``: n_shingles, node and sketch of filled sets. ``hints``: frequent values, the most frequent last.
    """
    by_value = np.argsort(hints)
    known = hints[by_value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sketches, sizes = batch.column("sketch"), batch.column("n_shingles").to_numpy()
            flat = sketches.flatten().to_numpy().view(np.uint64)
            held = sketches.value_lengths().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(held)), held)
            rank = _ranked(flat, known, by_value)
            frequent = np.bincount(owner[rank > 0], minlength=len(held))
            long = held - np.minimum(held, _least_shared(sizes)) + 1
            length = np.where(frequent * FEW <= held, np.minimum(long, NEAR), long)
            order = np.lexsort((flat, rank, owner))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(held) - held, held)
            chosen = order[place < np.repeat(length, held)]
            cuts = lambda n: pa.array(np.cumsum(np.r_[0, n]).astype(np.int32))
            prefix = pa.ListArray.from_arrays(cuts(length), pa.array(flat[chosen].view(np.int64)))
            ranked = pa.ListArray.from_arrays(cuts(held), pa.array(_high(flat[order])))
            yield from pa.table({"node": batch.column("node"), "size": sizes, "prefix": prefix, "ranked": ranked}).combine_chunks().to_batches()

    return told.select("n_shingles", "node", "sketch").mapInArrow(run, "node long, size long, prefix array<long>, ranked array<int>")


def _similar_sizes(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _union_allows(a: str, b: str, na: str, nb: str, percent: int) -> Column:
    """Whether the smallest values of the union, of which both sets must hold a share, leave the threshold possible."""
    both = F.array_intersect(a, b)
    bottom = F.slice(F.sort_array(F.array_union(a, b)), 1, K)
    # Whole sets can be told here; one more, as different hashes may have equal upper halves.
    whole = 100 * (F.size(both) + 1) >= percent * (F.col(na) + F.col(nb) - F.size(both))
    enough = (F.size(both) >= UNION_LEAST) & (F.size(F.array_intersect(both, bottom)) >= UNION_LEAST)
    return F.when(F.greatest(na, nb) <= K, whole).otherwise(enough)


def _hot(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes that many pairs name, and over how many tasks their pairs are dealt out."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("hot")).groupBy("hot").count().filter(F.col("count") > SPLIT)
    hot = scratch.write(named.select("hot", F.ceil(F.col("count") / SPLIT).cast("int").alias("parts")), "hot")
    return F.broadcast(hot) if hot.count() <= HOT_NODES else hot


def _attach(pairs: DataFrame, key: str, other: str, table: DataFrame, hot: DataFrame) -> DataFrame:
    """``pairs`` with the row of ``table`` (node, ...) that ``key`` names."""
    dealt = pairs.join(hot, F.col(key) == F.col("hot"), "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(other), "parts").cast("int"), F.lit(0))).drop("hot", "parts")
    rows = table.join(hot, F.col("node") == F.col("hot"), "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("hot", "parts")
    return dealt.join(rows, (F.col(key) == F.col("node")) & (F.col("salt") == F.col("part"))).drop("node", "salt", "part")


def _estimated(pairs: DataFrame, sketches: DataFrame, percent: int, hot: DataFrame) -> DataFrame:
    both = _attach(pairs, "a", "b", sketches.select("node", F.col("ranked").alias("s_a"), F.col("size").alias("n_a")), hot)
    both = _attach(both, "b", "a", sketches.select("node", F.col("ranked").alias("s_b"), F.col("size").alias("n_b")), hot)
    return both.filter(_similar_sizes("n_a", "n_b", percent)).filter(_union_allows("s_a", "s_b", "n_a", "n_b", percent)).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int, hot: DataFrame) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, PAIR_ROWS):
                part = batch.slice(at, PAIR_ROWS)
                left, right = part.column("t_a").to_pylist(), part.column("t_b").to_pylist()
                distinct = list(dict.fromkeys(left + right))
                sets = dict(zip(distinct, shingle_sets([job.decompress(t) for t in distinct], shingle), strict=True))
                good = []
                for x, y in zip(left, right, strict=True):
                    p, q = sets[x], sets[y]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    good.append(100 * both >= percent * (len(p) + len(q) - both))
                found = pa.array(good, pa.bool_())
                yield from pa.table({"a": part.column("a").filter(found), "b": part.column("b").filter(found)}).combine_chunks().to_batches()

    both = _attach(pairs, "a", "b", texts.select("node", F.col("text").alias("t_a")), hot)
    both = _attach(both, "b", "a", texts.select("node", F.col("text").alias("t_b")), hot)
    return both.select("a", "b", "t_a", "t_b").mapInArrow(run, "a long, b long")


def _top_values(rows: DataFrame) -> np.ndarray:
    """The values that most rows hold, at most HINTS, the most frequent last. They set an order, nothing else."""
    often = rows.groupBy("value").count().filter("count > 3")
    return np.array([r["value"] for r in often.orderBy(F.desc("count"), "value").limit(HINTS).collect()][::-1], np.int64).view(np.uint64)


def _shown(texts: DataFrame, shingle: int) -> DataFrame:
    """``value`` for each shingle of the full sets of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job = zstandard.ZstdDecompressor()
        for batch in batches:
            for x in shingle_sets([job.decompress(t) for t in batch.column("text").to_pylist()], shingle):
                yield from pa.table({"value": x.view(np.int64)}).to_batches(max_chunksize=1 << 16)

    return texts.select("text").mapInArrow(run, "value long")


def full_prefixes(texts: DataFrame, hints: np.ndarray, percent: int, shingle: int) -> DataFrame:
    """value, node, component, size and place: of each full set, rarest values first, as many as a similar set must meet one of.

    Sets with few frequent values take their NEAR smallest others, as sketches do.
    """
    by_value = np.argsort(hints)
    known = hints[by_value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job = zstandard.ZstdDecompressor()
        for batch in batches:
            sets = shingle_sets([job.decompress(t) for t in batch.column("text").to_pylist()], shingle)
            for x, node, component in zip(sets, batch.column("node").to_pylist(), batch.column("component").to_pylist(), strict=True):
                rank = _ranked(x, known, by_value)
                length = len(x) + 1 - -(-len(x) * percent // 100)
                if np.count_nonzero(rank) * FEW <= len(x):
                    length = min(length, NEAR)
                first = x[np.lexsort((x, rank))[:length]].view(np.int64)
                same = lambda v: pa.array(np.full(len(first), v, np.int64))  # noqa: E731, B023
                yield from pa.table({"value": first, "node": same(node), "component": same(component), "size": same(len(x)), "place": np.arange(len(first))}).to_batches(max_chunksize=1 << 16)

    return texts.select("node", "component", "text").mapInArrow(run, "value long, node long, component long, size long, place long")


def _across(entries: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components with a common value behind whose places enough values are left."""
    parts = entries.groupBy("value", "component").agg(F.count("*").alias("n"))
    spread = parts.groupBy("value").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("parts")).filter("parts > 1")
    met = scratch.write(entries.join(spread.select("value", "main", F.ceil(F.col("n") / SPLIT).cast("int").alias("split")), "value"), "met")
    # Members of a list's largest component meet only others; a long list's members are dealt out, and the others meet each part.
    few = met.filter("component <> main").select("value", F.explode(F.sequence(F.lit(0), F.col("split") - 1)).alias("part"), F.col("node").alias("x"), F.col("component").alias("cx"), F.col("size").alias("nx"), F.col("place").alias("px"))
    every = met.select("value", F.pmod(F.xxhash64("node"), "split").cast("int").alias("part"), F.col("node").alias("y"), F.col("component").alias("cy"), F.col("size").alias("ny"), F.col("place").alias("py"), "main")
    room = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent
    both = few.join(every, ["value", "part"]).filter((F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("main")) | (F.col("x") < F.col("y"))) & _similar_sizes("nx", "ny", percent) & room)
    return both.select(F.col("x").alias("a"), F.col("y").alias("b"))


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node and component (its smallest member) for the nodes of ``edges`` (a, b), by alternating large and small stars."""
    scratch = scratch or Scratch(edges.sparkSession)
    now = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    signature, pairs = None, now.count()

    def told(rows: DataFrame, least: DataFrame) -> DataFrame:
        """Each row with its centre's ``m``; the rows of a centre of more than SPLIT (``n``) are dealt out."""
        parts = F.ceil(F.col("n") / SPLIT).cast("int")
        hot = least.filter(F.col("n") > SPLIT).select("a", parts.alias("parts"))
        # No more than 2 * pairs / SPLIT centres are hot.
        hot = F.broadcast(hot) if 2 * pairs <= HOT_NODES * SPLIT else hot
        dealt = rows.join(hot, "a", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("b"), "parts").cast("int"), F.lit(0))).drop("parts")
        sides = least.select("a", "m", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        return dealt.join(sides, ["a", "part"]).drop("part")

    while True:
        # Large star: every larger neighbour of a node is linked to the smallest member of the neighbourhood.
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.write(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "least")
        large = scratch.write(told(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        low = scratch.write(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "low")
        small = told(large, low).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = scratch.write(small.filter("a <> b").distinct(), "edges")
        scratch.drop(now, large, least, low)
        now = after
        row = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if tuple(row) == signature:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        signature, pairs = tuple(row), row["n"]


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, n_shingles, class_id (smallest id with the same set), component_id (smallest id reachable), kept and first.

    ``kept``: whether the id is the component's. ``first`` is true for one text of each component, in all rows that hold
    it under the component's id; it differs from ``kept`` only where ids are null or repeat with other texts.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    # Let Spark drop, by a Bloom filter of bounded size, texts that no list names before they are shuffled. Joins are
    # planned alike at every size: sides that grow with the documents go by shuffle, even while they are small.
    values = {f"spark.sql.optimizer.runtime.bloomFilter.{key}": value for key, value in BLOOM.items()}
    with _settings(spark, values | {BROADCAST: "-1"}) as before:
        return _link(docs, id_col, text_col, percent, shingle, before[BROADCAST])


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[dict[str, str]]:
    """Set the session's configurations for a while; the values they had."""
    before = {name: spark.conf.get(name) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield before
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _link(docs: DataFrame, id_col: str, text_col: str, percent: int, shingle: int, broadcast: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    text = docs[text_col].cast("string")
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("told"), text.alias("text"))
    told = scratch.write(measured(base, shingle), "sets")
    filled = told.filter("n_shingles > 0")
    shown = filled.filter(F.pmod("node", F.lit(HINT_SHARE)) == 0).select("node", "sketch").dropDuplicates(["node"])
    heads = scratch.write(prefixes(filled, _top_values(shown.select(F.explode("sketch").alias("value")))), "prefixes")
    ids = scratch.write(told.drop("sketch", "pressed"), "ids")
    filled = ids.filter("n_shingles > 0")
    rows = heads.select("node", F.explode("prefix").alias("value"))
    # Lists of two nodes or more; copies of one set are one node.
    listed = rows.groupBy("value").agg(F.min("node").alias("low"), F.max("node").alias("top")).filter("low < top").select("value")
    lists = scratch.write(rows.join(listed, "value").distinct(), "lists")
    # One sketch and one text for each node that any list pairs with another.
    by_id = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    owners = filled.groupBy("node").agg(F.min(by_id).alias("one"), F.max("n_shingles").alias("size"), F.count("*").alias("copies"))
    owners = scratch.write(owners.select("node", F.col("one.doc_id").alias("owner"), "size", "copies"), "owners")
    wanted = owners.join(lists.groupBy("node").agg(F.count("*").alias("lists")), "node")
    wanted = scratch.write(wanted.select("node", "size", "lists"), "wanted").filter("size > 0")
    sketches = heads.select("node", "size", "ranked").join(wanted.select("node"), "node", "left_semi")
    sketches = scratch.write(sketches.dropDuplicates(["node"]), "sketches")
    # Texts of one set are alike here, so any row's will do.
    texts = told.filter("pressed IS NOT NULL").select("node", F.col("pressed").alias("text")).join(wanted.select("node"), "node", "left_semi")
    texts = scratch.write(texts.dropDuplicates(["node"]), "texts")
    scratch.drop(heads, told)
    links: DataFrame | None = None
    done: DataFrame | None = None
    state: DataFrame | None = None

    def settle(pairs: DataFrame) -> float:
        """Link what is similar among the pairs; the share of them that was."""
        nonlocal links, done, state
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = scratch.write(pairs, "pairs")
        done = pairs if done is None else done.unionByName(pairs)
        hot = _hot(pairs, scratch)
        near = scratch.write(_estimated(pairs, sketches, percent, hot), "near")
        # Spark builds a Bloom filter only of a side with a condition; this one always holds.
        named = scratch.write(near.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("named", F.lit(1)), "named")
        found = scratch.write(_verified(near, texts.join(named.filter("named > 0").select("node"), "node", "left_semi"), percent, shingle, hot), "links")
        scratch.drop(near, named)
        linked = found.count()
        if links is None or linked:
            links = found if links is None else links.unionByName(found)
            # The stars' tables are small against the documents, so Spark may plan them as usual.
            with _settings(docs.sparkSession, {BROADCAST: broadcast}):
                state = components(links, scratch)
        return linked / max(pairs.count(), 1)

    def apart() -> DataFrame:
        """Members of lists that span several components."""
        assert state is not None
        here = lists.join(state.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("value", "node", F.coalesce("component", "node").alias("component"))
        spread = here.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("value")
        return scratch.write(here.join(spread, "value", "left_semi"), "apart")

    # The original of a family has no own values, so it stands in the most lists.
    central = F.max_by("node", F.struct("lists", F.xxhash64("node"), "node")).alias("hub")
    hubs = lists.join(wanted.select("node", "lists"), "node").groupBy("value").agg(central)
    settle(lists.join(hubs, "value").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    turn, linked = 0, 1.0
    while linked > ENOUGH:
        turn += 1
        here = apart()
        picked = here.groupBy("value").agg(F.max(F.struct(F.xxhash64("node", "value", F.lit(turn)), "node", "component")).alias("hub"))
        linked = settle(here.join(picked, "value").filter("component <> hub.component").select(F.col("node").alias("a"), F.col("hub.node").alias("b")))
        scratch.drop(here)
    here = apart()
    still = scratch.write(here.select("node", "component").distinct().withColumn("named", F.lit(1)), "open")
    sample = still.filter(F.pmod("node", F.lit(HINT_SHARE)) == 0)
    hints = _top_values(_shown(texts.join(sample, "node"), shingle))
    entries = scratch.write(full_prefixes(texts.join(still.filter("named > 0"), "node"), hints, percent, shingle), "entries")
    scratch.drop(here, still)
    settle(_across(entries, percent, scratch))
    scratch.drop(entries, texts, sketches, lists)
    assert state is not None
    # Back to documents: the smallest id of each set, and of each component. Sets without copies or links are told by themselves.
    joined = owners.join(state.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
    known = joined.filter("copies > 1 OR n IS NOT NULL").select("node", "owner", F.coalesce("component", "node").alias("component"))
    more = known.select(F.col("component").alias("node")).distinct().join(owners, "node").select("node", "owner", F.col("node").alias("component"))
    known = scratch.write(known.unionByName(more).distinct(), "nodes")
    smallest = known.groupBy("component").agg(F.min(F.struct(F.col("owner").isNull(), "owner", "node")).alias("least"))
    smallest = smallest.select("component", F.col("least.owner").alias("component_id"), F.col("least.node").alias("first_node"))
    ends = scratch.write(known.join(smallest, "component").select(F.col("node").alias("n"), "owner", "component_id", "first_node"), "ends")
    # A set with very many copies is dealt out to several tasks.
    sides = ends.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = ids.select("doc_id", "told", "n_shingles", "node", F.pmod(F.xxhash64("doc_id", "told"), F.lit(SALTS)).cast("int").alias("salt"))
    out = dealt.join(sides, (F.col("n_shingles") > 0) & (F.col("node") == F.col("n")) & (F.col("salt") == F.col("part")), "left")
    by_end = lambda c: F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col(c))
    out = out.select("doc_id", F.col("told").alias("text_hash"), "n_shingles", by_end("owner").alias("class_id"), by_end("component_id").alias("component_id"), F.coalesce(F.col("node") == F.col("first_node"), F.lit(True)).alias("own"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return out.withColumn("kept", kept).withColumn("first", kept & F.col("own")).drop("own")
