"""Phrases of words that stand together more often than chance, mined by SETM on persisted, sorted occurrence relations.

Texts are cut into pieces at punctuation and pieces into words. The first relation holds each occurrence of a word, by
piece and position. Groups of a language are counted; those below the support go, and the relation is semi-joined with
the rest before it is extended: a relation of phrases of k words is merge-joined with that of single words where the
piece is the same and the word stands right behind the phrase, which gives the occurrences of k + 1 words. Of these, too,
only the frequent groups are kept and persisted, sorted as before.

A relation is stored as one row a chunk of text: positions in rising order, in which every end of a piece takes a
position of its own (so what is adjacent lies in one piece), with the chunk's number of the group at each. A chunk sends
a row for each of its distinct groups, never one an occurrence: those rows are counted by group, and of the frequent ones
the chunk's numbers come back to it. So a shuffle is as large as the chunks' distinct groups, a key has at most a row a
chunk however frequent it is, and texts are never shuffled. Words get exact numbers, so groups never collide.

Candidates are all phrases of 2 to ``longest`` words of the support. The score of a cut is floor(10 ** 6 * a * a / (l *
r)), in decimals of 38 digits (exact while a stays below 10 ** 15); the lowest cut counts, the first of equal ones. A
candidate goes if a longer candidate that holds it has at least half of its count. The best of each language stay, by
score, count and phrase.

Null text has no words, a null language is ``und``. Repeated rows count as often as they come; ids aren't read. Ties are
told by the phrase's bytes. An empty table gives no rows, nor does a language without candidates. A very long text is
split between chunks at ends of pieces; a piece itself is never split. Other columns are free to have any name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, utf8

#: Occurrences in a chunk, and bytes of text that are split at a time.
CHUNK_WORDS, SLICE_BYTES = 2 << 20, 4 << 20
#: Rows of an Arrow batch of results.
OUT_ROWS = 1 << 15
#: Parts of a language whose best phrases are found apart before they are compared.
PARTS = 256
#: What ends a piece, besides the end of the text.
ENDS = b".,;:!?\n\v\f\r"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + ENDS, b"abcdefghijklmnopqrstuvwxyz" + b"." * len(ENDS))
_SCHEMA = "chunk long, lang string, number int, word string, c long, at binary, held binary"


def _pack(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype(np.int32).tobytes())


def _unpack(stored: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(stored), np.int32)


def _pack_at(places: np.ndarray) -> bytes:
    """Rising positions as steps from one to the next."""
    return _pack(np.diff(places, prepend=0))


def _unpack_at(stored: bytes) -> np.ndarray:
    return np.cumsum(_unpack(stored), dtype=np.int32)


def _slices(text: bytes) -> Iterator[bytes]:
    """Parts of a folded text that end where a piece ends."""
    start = 0
    while len(text) - start > SLICE_BYTES:
        cut = text.rfind(b".", start, start + SLICE_BYTES) + 1 or text.find(b".", start + SLICE_BYTES) + 1 or len(text)
        yield text[start:cut]
        start = cut
    yield text[start:]


class _Chunk:
    """Words of one language in a task, numbered as they first come; number 0 is the end of a piece."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.number[b"."]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        words = text.replace(b".", b" . ").split()
        words.append(b".")
        self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def rows(self, chunk: int, lang: str) -> Iterator[pa.RecordBatch]:
        """The relation in a row, then a row a distinct word."""
        held = np.concatenate(self.parts)
        self.parts.clear()
        times = np.bincount(held, minlength=len(self.number))[1:]
        at = np.flatnonzero(held)
        yield self._batch(1, chunk, lang, at=pa.array([_pack_at(at)], pa.binary()), held=pa.array([_pack(held[at])], pa.binary()))
        words = pa.array(self.number, pa.binary())[1:].cast(pa.string())
        self.number.clear()
        for start in range(0, len(words), OUT_ROWS):
            part = words[start : start + OUT_ROWS]
            number = np.arange(start + 1, start + len(part) + 1, dtype=np.int32)
            yield self._batch(len(part), chunk, lang, number=pa.array(number), word=part, c=pa.array(times[start : start + OUT_ROWS]))

    @staticmethod
    def _batch(n: int, chunk: int, lang: str, **filled: pa.Array) -> pa.RecordBatch:
        kinds = {"number": pa.int32(), "word": pa.string(), "c": pa.int64(), "at": pa.binary(), "held": pa.binary()}
        return pa.record_batch({"chunk": pa.repeat(chunk, n), "lang": pa.repeat(lang, n)} | {c: filled[c] if c in filled else pa.nulls(n, kind) for c, kind in kinds.items()})


def occurrences(docs: DataFrame) -> DataFrame:
    """The first relation before any group is dropped: rows of words with their number and count in a chunk, and a row a chunk with positions and numbers."""
    bound_batches(docs.sparkSession)
    rows = docs.filter("text IS NOT NULL").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, chunks, made = TaskContext.get().partitionId() << 32, defaultdict(_Chunk), count()
        for batch in batches:
            by_lang: dict[str, list[bytes]] = defaultdict(list)
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(pa.Table.from_batches([batch]), "text"), strict=True):
                by_lang[lang].append(text)
            for lang, texts in by_lang.items():
                for part in _slices(b".".join(texts).translate(_FOLD)):
                    chunks[lang].add(part)
                    if chunks[lang].size >= CHUNK_WORDS:
                        yield from chunks.pop(lang).rows(base + next(made), lang)
        while chunks:
            lang, chunk = chunks.popitem()
            yield from chunk.rows(base + next(made), lang)

    return rows.mapInArrow(run, _SCHEMA)


def _longs(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


#: A stored relation: that of single words with their ids, and from two words on that of phrases with the ids of each word.
_WORDS = "chunk long, word_at binary, word binary, word_ids array<long>"
_PHRASES = ", at binary, held binary, ids array<array<long>>"


def _frequent_words(relations: DataFrame, told: DataFrame) -> DataFrame:
    """The relation of frequent words, renumbered from 0 in order, with the ids of the numbers."""
    lists = told.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("number", "id"))).alias("g"))  # at most as many as the chunk has words
    rows = relations.join(lists, "chunk").select("chunk", "at", "held", F.col("g.number").alias("kept"), F.col("g.id").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, held = _unpack_at(batch.column("at")[i].as_py()), _unpack(batch.column("held")[i].as_py())
                kept = _longs(batch.column("kept"), i)
                number = np.full(int(max(held.max(), kept.max())) + 1, -1, np.int32)
                number[kept] = np.arange(len(kept))
                number = number[held]
                stays = number >= 0
                yield pa.record_batch({
                    "chunk": batch.column("chunk").slice(i, 1), "word_at": pa.array([_pack_at(at[stays])], pa.binary()),
                    "word": pa.array([_pack(number[stays])], pa.binary()), "word_ids": batch.column("ids").slice(i, 1),
                })

    return rows.mapInArrow(run, _WORDS)


def _merge_joined(at: np.ndarray, held: np.ndarray, word_at: np.ndarray, word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of k words with the words right behind them: positions, and phrase and word as one number."""
    place = np.searchsorted(word_at, at + np.int32(k))
    there = place < len(word_at)
    there[there] = word_at[place[there]] == at[there] + k
    pair = held[there].astype(np.int64) << 32
    pair |= word[place[there]]
    return at[there], pair


class _Grown:
    """One chunk's phrases of k words, extended by a word."""

    def __init__(self, batch: pa.RecordBatch, i: int, k: int) -> None:
        self.word_at, self.word = _unpack_at(batch.column("word_at")[i].as_py()), _unpack(batch.column("word")[i].as_py())
        self.word_ids = _longs(batch.column("word_ids"), i)
        at, held, self.ids = self.word_at, self.word, [self.word_ids]
        if k > 1:
            at, held = _unpack_at(batch.column("at")[i].as_py()), _unpack(batch.column("held")[i].as_py())
            self.ids = [x.values.to_numpy(zero_copy_only=False) for x in batch.column("ids")[i].values]
        self.at, self.pair = _merge_joined(at, held, self.word_at, self.word, k)

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct groups in order, and how often each comes."""
        ordered = np.sort(self.pair)
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
        return ordered[first], np.diff(np.r_[first, len(ordered)])

    def spelled(self, groups: np.ndarray) -> list[np.ndarray]:
        """Ids of the words of groups, an array a word."""
        return [*(x[groups >> 32] for x in self.ids), self.word_ids[groups & 0xFFFFFFFF]]


def _asked(relations: DataFrame, k: int) -> DataFrame:
    """A row a distinct group of k + 1 words and chunk: the chunk's number of it, its ids and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grown = _Grown(batch, i, k)
                groups, times = grown.groups()
                for start in range(0, len(groups), OUT_ROWS):
                    part = groups[start : start + OUT_ROWS]
                    ids = {f"i{n}": x for n, x in enumerate(grown.spelled(part), 1)}
                    yield pa.record_batch({"chunk": pa.repeat(batch.column("chunk")[i], len(part)), "number": np.arange(start, start + len(part), dtype=np.int32)} | ids | {"c": times[start : start + OUT_ROWS]})

    return relations.mapInArrow(run, "chunk long, number int, " + "".join(f"i{n} long, " for n in range(1, k + 2)) + "c long")


def _semi_joined(relations: DataFrame, kept: DataFrame, k: int) -> DataFrame:
    """The relation of the frequent groups of k + 1 words, by the chunks' numbers of them; chunks without any are left out."""
    lists = kept.groupBy("chunk").agg(F.array_sort(F.collect_list("number")).alias("kept"))  # at most as many as the chunk has words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grown = _Grown(batch, i, k)
                groups = grown.groups()[0][_longs(batch.column("kept"), i)]
                number = np.minimum(np.searchsorted(groups, grown.pair), len(groups) - 1)
                stays = groups[number] == grown.pair
                row = {c: batch.column(c).slice(i, 1) for c in ("chunk", "word_at", "word", "word_ids")}
                row |= {"at": pa.array([_pack_at(grown.at[stays])], pa.binary()), "held": pa.array([_pack(number[stays])], pa.binary())}
                yield pa.record_batch(row | {"ids": pa.array([grown.spelled(groups)], pa.list_(pa.list_(pa.int64())))})

    return relations.join(lists, "chunk").mapInArrow(run, _WORDS + _PHRASES)


def candidates(docs: DataFrame, longest: int = 3, support: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (lang, word, id, a), frequent phrases of 2 to ``longest`` words (ids, a), and words a language (lang, n); ids tell the language."""
    scratch = Scratch(docs.sparkSession)
    first = scratch.write(occurrences(docs), "occurrences")
    asked = first.filter("word IS NOT NULL").select("chunk", "lang", "number", "word", "c")
    sizes = scratch.write(asked.groupBy("lang").agg(F.sum("c").alias("n")), "sizes")
    # One exchange by group serves both the count and the semi-join; a key has at most a row a chunk. A word's id is the least of its rows'.
    same = Window.partitionBy("lang", "word")
    told = asked.withColumn("row", F.monotonically_increasing_id()).withColumns({"a": F.sum("c").over(same), "id": F.min("row").over(same)})
    told = scratch.write(told.filter(F.col("a") >= support).select("chunk", "number", "id", "row", "lang", "word", "a"), "words")
    frequent = scratch.write(told.filter("row = id").select("lang", "word", "id", "a"), "frequent")
    relation = scratch.write(_frequent_words(first.filter("word IS NULL").select("chunk", "at", "held"), told.select("chunk", "number", "id")), "relation1")
    scratch.drop(first, told)
    found = []
    for k in range(1, longest):
        ids = [f"i{n}" for n in range(1, k + 2)]
        asks = _asked(relation, k)
        if k + 1 < longest:
            by_group = asks.withColumns({"a": F.sum("c").over(Window.partitionBy(*ids)), "one": F.row_number().over(Window.partitionBy(*ids).orderBy("chunk"))})
            kept = scratch.write(by_group.filter(F.col("a") >= support), f"groups{k + 1}")
            counts = kept.filter("one = 1")
            grown = scratch.write(_semi_joined(relation, kept.select("chunk", "number"), k), f"relation{k + 1}")
            found.append(scratch.write(counts.select(F.array(*ids).alias("ids"), "a"), f"phrases{k + 1}"))
            scratch.drop(relation, kept)
            relation = grown
        else:
            counts = asks.groupBy(*ids).agg(F.sum("c").alias("a")).filter(F.col("a") >= support)
            found.append(scratch.write(counts.select(F.array(*ids).alias("ids"), "a"), f"phrases{k + 1}"))
    scratch.drop(relation)
    every = found[0] if found else docs.sparkSession.createDataFrame([], "ids array<long>, a long")
    for more in found[1:]:
        every = every.unionByName(more)
    return frequent, every, sizes


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(10 ** 6 * a * a / (l * r)) without rounding: the remainder of the whole quotient is taken off first."""
    wide = a.cast("decimal(16,0)") * a.cast("decimal(16,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", wide.cast("decimal(38,0)"), (l.cast("decimal(18,0)") * r.cast("decimal(18,0)")).cast("decimal(38,0)")).cast("long")


def scored(frequent: DataFrame, phrases: DataFrame) -> DataFrame:
    """ids, a, l, r, score of the lowest-scoring cut of each phrase, the first of equal ones."""
    known = frequent.select(F.array("id").alias("part"), F.col("a").alias("f")).unionByName(phrases.select(F.col("ids").alias("part"), F.col("a").alias("f")))
    cuts = F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")
    left, right = F.slice("ids", F.lit(1), F.col("k")), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))
    rows = phrases.select("ids", "a", cuts).select("ids", "a", "k", left.alias("first"), right.alias("rest"))
    rows = rows.join(known.withColumnsRenamed({"part": "first", "f": "l"}), "first").join(known.withColumnsRenamed({"part": "rest", "f": "r"}), "rest")
    rows = rows.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    best = rows.groupBy("ids").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"), F.first("a").alias("a"))
    return best.select("ids", "a", "best.l", "best.r", "best.score")


def maximal(rows: DataFrame, phrases: DataFrame, longest: int, share: int = 50) -> DataFrame:
    """``rows`` without phrases that some longer candidate holds with at least ``share`` percent of their count."""
    inner = [F.slice("ids", F.lit(start), F.lit(size)).alias("ids") for size in range(2, longest) for start in range(1, longest - size + 2)]
    if not inner:
        return rows
    parts = F.explode(F.filter(F.array(*inner), lambda p: (F.size(p) >= 2) & (F.size(p) < F.size("ids")))).alias("part")
    held = phrases.filter(F.size("ids") > 2).select("ids", "a", parts).groupBy(F.col("part").alias("ids")).agg(F.max("a").alias("longer"))
    return rows.join(held, "ids", "left").filter(F.coalesce(F.lit(100).cast("decimal(20,0)") * F.col("longer").cast("decimal(18,0)") < F.lit(share).cast("decimal(20,0)") * F.col("a").cast("decimal(18,0)"), F.lit(True))).drop("longer")


def mine(docs: DataFrame, longest: int = 3, support: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each language."""
    frequent, phrases, sizes = candidates(docs, longest, support)
    rows = maximal(scored(frequent, phrases), phrases, longest, share)
    spelled = rows.select("*", F.posexplode("ids").alias("place", "id")).join(frequent.select("id", "lang", "word"), "id")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda w: w["word"]), " ")
    named = spelled.groupBy("ids").agg(F.first("lang").alias("lang"), words.alias("phrase"), *[F.first(c).alias(c) for c in ("a", "l", "r", "score")])
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each part of a language first, so that no task sorts a whole language.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    few = named.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
