"""Byte-level BPE by merge replay over the distinct words of the whole corpus.

A chunk of documents asks for the ids of its distinct words that aren't tokens themselves. All chunks' words are dealt
out to shards by their hash and sorted there, so equal words meet and every word of the corpus is merged once, wherever
it stands. In a shard all words are laid out as one array of byte tokens with links to both neighbours, and an inverted
index leads from a token pair, by the rank of what it makes, to the word positions that hold it. Merges are then applied
in rank order over all words at once; each touches only its two neighbours, whose new pairs enter the index. The ids go
back to a folder for each chunk. Documents are then read once more, in the same chunks: a document's ids are its words'
ids in order. Ids tell their word, so no word is sent back, and texts are never shuffled. Should an input be cut
otherwise when read again, the words that a chunk doesn't find in its folder are replayed there. ``Coder`` does the same
for texts at hand, without Spark.

Null text counts as empty; an empty text has no ids. Repeated rows give equal rows, an empty table none. A very long
text stays in one chunk. Ranks are unique, so there are no ties but positions of one pair, which merge from the left.
Only the id and text columns are read; ``keep`` names others to carry along, which may not be called as an output.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import blocks, bound_batches, shared_dir

#: Rows of an Arrow batch of results.
OUT_ROWS = 256
#: Bytes of text in a chunk, which asks once for each of its words.
CHUNK_BYTES = 16 << 20
#: Words whose ids a ``Coder`` remembers; a full memory is emptied, which changes no result.
MEMORY_WORDS = 400_000
#: Bytes of words that a shard lays out at a time.
SHARD_BYTES = 4 << 20
#: Merges with fewer positions are applied one by one.
SCALAR_BELOW = 32
#: Below this code point the pattern's classes are spelled out for the quicker ``re`` module.
NEAR = 0x250


class Ranks:
    """Tokens by rank, and for each pair of tokens the rank of what they join to."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.single = [self.rank.get(bytes([b]), -1) for b in range(256)]
        self.pair: dict[int, int] = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    self.pair[left << 32 | right] = rank
        self.pairs = Pairs(self.pair)


@cache
def ranks(path: str) -> Ranks:
    return Ranks(path)


class Pairs:
    """The pair table as an open-addressed numpy table, for many look-ups at once."""

    def __init__(self, pair: dict[int, int]) -> None:
        keys = np.fromiter(pair.keys(), np.int64, len(pair))
        values = np.fromiter(pair.values(), np.int32, len(pair))
        self.bits = max(4, int(len(pair) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left, right) -> np.ndarray:
        """Ranks, -1 where the two tokens join to none."""
        keys = (np.asarray(left, np.int64) << 32) | np.asarray(right, np.int64)
        slot = self._slot(keys)
        found, out = self.keys[slot], self.values[slot]
        wrong = np.flatnonzero((found != keys) & (found >= 0))
        out = np.where(found == keys, out, np.int32(-1))
        while len(wrong):
            slot_w = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            slot[wrong] = slot_w
            there = self.keys[slot_w]
            hit = there == keys[wrong]
            out[wrong[hit]] = self.values[slot_w[hit]]
            wrong = wrong[~hit & (there >= 0)]
        return out


class Replay:
    """One corpus of words, its links and its inverted index."""

    def __init__(self, words: list[bytes], r: Ranks) -> None:
        self.r = r
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(words), np.uint8)
        self.size = size = len(flat)
        # The numpy arrays and the Python arrays are two views of the same memory.
        self.tok = array("i", np.array(r.single, np.int32)[flat].tobytes())
        self.nxt = array("i", np.arange(1, size + 1, dtype=np.int32).tobytes())
        self.prv = array("i", np.arange(-1, size - 1, dtype=np.int32).tobytes())
        self.t, self.n, self.p = (np.frombuffer(x, np.int32) for x in (self.tok, self.nxt, self.prv))
        self.p[self.starts] = -1
        self.n[self.starts + lengths - 1] = -1
        self.few: dict[int, list[int]] = {}
        self.many: dict[int, list[np.ndarray]] = {}
        self.queue: list[int] = []
        inner = np.flatnonzero(self.n >= 0)
        self._add(r.pairs.get(self.t[inner], self.t[inner + 1]), inner.astype(np.int32))

    def _add(self, found: np.ndarray, at: np.ndarray) -> None:
        """Enter positions under the ranks of their pairs."""
        keep = found >= 0
        found, at = found[keep], at[keep]
        if not len(found):
            return
        order = np.argsort(found, kind="stable")
        found, at = found[order], at[order]
        cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
        for rank, s, e in zip(found[np.r_[0, cuts]].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(found)], strict=True):
            if rank not in self.few and rank not in self.many:
                heappush(self.queue, rank)
            self.many.setdefault(rank, []).append(at[s:e])

    def _put(self, rank: int, p: int) -> None:
        if rank in self.few:
            self.few[rank].append(p)
        else:
            if rank not in self.many:
                heappush(self.queue, rank)
            self.few[rank] = [p]

    def run(self) -> None:
        while self.queue:
            rank = heappop(self.queue)
            few, many = self.few.pop(rank, []), self.many.pop(rank, [])
            if len(few) + sum(map(len, many)) < SCALAR_BELOW:
                self._one_by_one(rank, sorted({*few, *(p for a in many for p in a.tolist())}))
            else:
                at = np.sort(np.concatenate([*many, np.array(few, np.int32)]))
                at = at[np.r_[True, at[1:] != at[:-1]]]
                if not self._together(rank, at):
                    self._one_by_one(rank, at.tolist())

    def _together(self, rank: int, at: np.ndarray) -> bool:
        """Apply a merge at all its positions; false, with nothing done, where the order within a word matters."""
        t, n, p, get = self.t, self.n, self.p, self.r.pairs.get
        at = at[(n[at] >= 0) & (t[at] >= 0)]
        at = at[get(t[at], t[n[at]]) == rank]
        if not len(at):
            return True
        second = n[at]
        if (second[:-1] == at[1:]).any():
            return False
        beyond, back = n[second], p[at]
        has_beyond, has_back = beyond >= 0, back >= 0
        right = get(rank, t[beyond[has_beyond]])
        left = get(t[back[has_back]], rank)
        if ((right >= 0) & (right < rank)).any() or ((left >= 0) & (left < rank)).any() or 0 <= self.r.pair.get(rank << 32 | rank, -1) < rank:
            return False
        t[at], t[second], n[at] = rank, -1, beyond
        p[beyond[has_beyond]] = at[has_beyond]
        back = p[at]
        back = back[back >= 0]
        ahead = at[has_beyond]
        self._add(np.concatenate([get(t[back], rank), get(rank, t[n[ahead]])]), np.concatenate([back, ahead]))
        return True

    def _one_by_one(self, rank: int, positions: list[int]) -> None:
        tok, nxt, prv, get, put = self.tok, self.nxt, self.prv, self.r.pair.get, self._put
        open_from = 0  # a lower rank that came up in a word goes first there; the word's other positions wait
        for p in positions:
            q = nxt[p]
            if q < 0 or tok[p] < 0 or get(tok[p] << 32 | tok[q]) != rank:
                continue
            if p < open_from:
                put(rank, p)
                continue
            beyond, back = nxt[q], prv[p]
            tok[p], tok[q], nxt[p] = rank, -1, beyond
            if beyond >= 0:
                prv[beyond] = p
                if (x := get(rank << 32 | tok[beyond])) is not None:
                    put(x, p)
                    if x < rank:
                        open_from = self._end(p)
            if back >= 0 and (x := get(tok[back] << 32 | rank)) is not None:
                put(x, back)
                if x < rank:
                    open_from = self._end(p)

    def _end(self, p: int) -> int:
        k = int(np.searchsorted(self.starts, p, "right"))
        return int(self.starts[k]) if k < len(self.starts) else self.size

    def ids(self) -> list[bytes]:
        alive = self.t >= 0
        packed = self.t[alive].astype("<u4").tobytes()
        bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(alive)])[np.append(self.starts, self.size)] * 4
        b = bounds.tolist()
        return [packed[s:e] for s, e in zip(b, b[1:], strict=False)]


def replay(words: list[bytes], r: Ranks) -> list[bytes]:
    """The ids of each word, packed as little-endian 32-bit integers; whole words of the vocabulary take their own id."""
    out = [b"" if not w else known.to_bytes(4, "little") if (known := r.rank.get(w)) is not None else None for w in words]
    rest = [k for k, x in enumerate(out) if x is None]
    if rest:
        job = Replay([words[k] for k in rest], r)
        job.run()
        for k, x in zip(rest, job.ids(), strict=True):
            out[k] = x
    return out  # type: ignore[return-value]


def _near(category: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(NEAR) if unicodedata.category(chr(c))[0] == category)


@cache
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """findall of the pattern; texts of near code points take an equal pattern with spelled-out classes."""
    slow = regex.compile(pattern).findall
    classes = {r"\p{L}": _near("L"), r"\p{N}": _near("N"), r"\s": "\\t-\\r \\x85\\xa0"}

    def spell(m: re.Match) -> str:
        if m[0].startswith("(?!"):
            return f"(?![^{classes[chr(92) + 's']}])"
        if m[0].startswith("["):
            return re.sub(r"\\p\{[LN]\}|\\s", lambda k: classes[k[0]], m[0])
        return f"[{classes[m[0]]}]"

    quick = re.compile(re.sub(r"\[[^\]]*\]|\(\?!\\S\)|\\p\{[LN]\}|\\s", spell, pattern)).findall
    far = re.compile(rf"[^\x00-{chr(NEAR - 1)}]").search
    return lambda text: slow(text) if far(text) else quick(text)


class Coder:
    """Encodes texts with a bounded memory of words."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks, self.split, self.known = ranks(path), splitter(pattern), {}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        new = {w for words in split for w in words} - self.known.keys()
        if len(self.known) + len(new) > MEMORY_WORDS:
            self.known.clear()
            new = {w for words in split for w in words}
        order = list(new)
        self.known.update(zip(order, replay([w.encode() for w in order], self.ranks), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        return decode(ids, self.ranks)


@cache
def whole_tokens(path: str) -> dict[str, bytes]:
    """Packed ids of the words that are tokens themselves."""
    out = {}
    for token, rank in ranks(path).rank.items():
        try:
            out[token.decode()] = rank.to_bytes(4, "little")
        except UnicodeDecodeError:
            continue
    return out


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches of a task, each with the key of its chunk."""
    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        yield part << 32 | seen // CHUNK_BYTES, batch
        seen += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0


def asked_words(docs: DataFrame, vocab_path: str, pattern: str) -> DataFrame:
    """key and word, once for each chunk of (text) and each of its words that isn't a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = splitter(pattern), whole_tokens(vocab_path).keys()
        at, held = -1, set()

        def flush() -> Iterator[pa.RecordBatch]:
            words = pa.array([w.encode() for w in held - known], pa.binary())
            yield from pa.table({"key": np.full(len(words), at, np.int64), "word": words}).to_batches(max_chunksize=1 << 14)

        for key, batch in _chunked(batches):
            if key != at:
                yield from flush()
                at, held = key, set()
            for text in batch.column("text").to_pylist():
                held.update(cut(text or ""))
        yield from flush()

    return docs.mapInArrow(run, "key long, word binary")


def merge_words(asked: DataFrame, vocab_path: str) -> DataFrame:
    """key and ids (of many words, each ended by ``_unit``'s end mark) of rows (key, word), by replay in shards of sorted words.

    A word that every chunk asks for has a row a chunk in its shard, which is small against the chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(vocab_path)
        unit, end = _unit(table)
        last, code = None, b""
        for block in blocks(batches, "word", SHARD_BYTES):
            coded = block.column("word").combine_chunks().dictionary_encode()
            words = coded.dictionary.to_pylist()
            again = words[0] == last
            codes = [code, *replay(words[1:], table)] if again else replay(words, table)
            last, code = words[-1], codes[-1]
            keys, places = block.column("key").to_numpy(), coded.indices.to_numpy()
            order = np.argsort(keys, kind="stable")
            cuts = np.flatnonzero(np.diff(keys[order])) + 1
            runs = np.split(places[order], cuts)
            packed = [np.frombuffer(end.join([*map(codes.__getitem__, run.tolist()), b""]), "<u4").astype(unit).tobytes() for run in runs]
            yield from pa.table({"key": keys[order][np.r_[0, cuts]], "ids": pa.array(packed, pa.binary())}).to_batches(max_chunksize=OUT_ROWS)

    return asked.repartition("word").sortWithinPartitions("word").mapInArrow(run, "key long, ids binary")


def _unit(table: Ranks) -> tuple[str, bytes]:
    """The numpy type that holds a vocabulary's ids and one more, and that one, as the end mark of a word, in four bytes."""
    small = len(table.token) < 0xFFFF
    return ("<u2" if small else "<u4"), (0xFFFF if small else 0xFFFFFFFF).to_bytes(4, "little")


def _told(folder: str, key: int, table: Ranks) -> dict[str, bytes]:
    """Packed ids by word, as the folder holds them for a chunk."""
    unit, end = _unit(table)
    fs, root = pyarrow.fs.FileSystem.from_uri(f"{folder}/key={key}")
    out: dict[str, bytes] = {}
    for info in fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)):
        if not info.base_name.endswith(".parquet"):
            continue
        with fs.open_input_file(info.path) as source:
            held = pq.ParquetFile(source).read(columns=["ids"]).column("ids").to_pylist()
        for blob in held:
            ids = np.frombuffer(blob, unit)
            ends = np.flatnonzero(ids == int.from_bytes(end, "little"))
            tokens = [table.token[i] if i < len(table.token) else b"" for i in ids.tolist()]
            stops = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))[ends].tolist()
            whole, packed = b"".join(tokens), ids.astype("<u4").tobytes()
            a = s = 0
            for b, e in zip(stops, (ends * 4).tolist(), strict=True):
                out[whole[a:b].decode()] = packed[s:e]
                a, s = b, e + 4
    return out


def encode(docs: DataFrame, vocab_path: str, pattern: str, outputs: tuple[str, ...] = ("ids",), id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its id, the kept columns and the asked outputs.

    ``ids`` array<int>, ``n_tokens`` long, ``decoded`` binary (the ids turned back to bytes), and the digests
    ``ids_sha256`` and ``decoded_sha256``. ``vocab_path`` names a rank file that every executor can open.
    """
    kinds = {"ids": "array<int>", "n_tokens": "long", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}
    bound_batches(docs.sparkSession)
    carried = [id_col, *keep]
    frame = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(carried)], docs[text_col].cast("string").alias("text"))
    names = [f"k{i}" for i in range(len(carried))]
    folder = f"{shared_dir(docs.sparkSession)}/doctide-ids-{uuid.uuid4().hex}"
    merged = merge_words(asked_words(frame, vocab_path, pattern), vocab_path)
    merged.repartition("key").write.option("compression", "zstd").partitionBy("key").parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cut = ranks(vocab_path), splitter(pattern)
        at, codes = -1, {}
        for key, batch in _chunked(batches):
            if key != at:
                at, codes = key, whole_tokens(vocab_path) | _told(folder, key, table)
            for start in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(start, OUT_ROWS)
                ids = []
                for text in part.column("text").to_pylist():
                    words = cut(text or "")
                    try:
                        ids.append(b"".join(map(codes.__getitem__, words)))
                    except KeyError:
                        new = list(set(words) - codes.keys())
                        codes.update(zip(new, replay([w.encode() for w in new], table), strict=True))
                        ids.append(b"".join(map(codes.__getitem__, words)))
                columns = {name: _output(name, ids, table) for name in outputs}
                yield from pa.table({**{c: part.column(c) for c in names}, **columns}).combine_chunks().to_batches()

    schema = "".join(f"{n} {frame.schema[n].dataType.simpleString()}, " for n in names) + ", ".join(f"{k} {kinds[k]}" for k in outputs)
    out = frame.mapInArrow(run, schema)
    return out.select(*[out[n].alias(c) for n, c in zip(names, carried, strict=True)], *outputs)


def decode(ids: bytes, table: Ranks) -> bytes:
    return b"".join(map(table.token.__getitem__, array("I", ids)))


def _output(name: str, ids: list[bytes], table: Ranks) -> pa.Array:
    match name:
        case "ids":
            return pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))
        case "n_tokens":
            return pa.array([len(x) >> 2 for x in ids], pa.int64())
        case "ids_sha256":
            return pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())
        case "decoded":
            return pa.array([decode(x, table) for x in ids], pa.binary())
        case _:
            return pa.array([hashlib.sha256(decode(x, table)).hexdigest() for x in ids], pa.string())
