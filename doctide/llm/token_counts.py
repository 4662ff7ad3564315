"""Exact token counts of every prefix of a text under a BPE piece model, by dynamic programming over prefixes.

The encoding of a prefix ends in one certain piece: the one that fits behind the last piece of the shorter prefix that
it leaves. Two pieces fit if no merge would ever have crossed the seam between them, which is told by undoing their
merges, latest first. So each prefix needs only the answers of the prefixes before it, and its count is one more than
that of the prefix that its last piece leaves. Where no piece of the vocabulary holds two neighbouring characters, the
text falls into words whose answers don't depend on each other; words are solved once and remembered.

``store`` keeps for every document the steps of the count from each prefix to the next, compressed. ``answer`` and
``tokens_at`` read only that: how many tokens the text or any prefix has, and how many characters fit into a budget
(the longest such prefix: counts may fall as a text grows), without encoding anything again.

Null text counts as empty; an empty text has no tokens and fits any budget. A prefix longer than the text is the whole
text, a negative or null one the empty one. Repeated rows give equal rows, an empty table none. A very long text is
solved word by word in one task: its steps take a byte a character before compression. Texts may hold any character;
strings of special tokens in them are ordinary text. Pieces of equal score merge from the left. Only the text is read;
``keep`` names columns to carry along, which may not be called as an output.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from .common import blocks, bound_batches, utf8

#: Bytes of text that a task holds at a time; a longer text makes a block of its own.
BLOCK_BYTES = 4 << 20
#: Words whose steps and seams whose verdict a worker remembers; of words as many again that were asked before. A full memory is emptied, which changes no result.
MEMORY_WORDS, MEMORY_SEAMS = 700_000, 1_000_000
#: Characters of the longest word that is remembered.
MEMORY_CHARS = 64
#: How the model writes a space.
SPACE = "▁"


class Pieces:
    """The pieces of a model with their ranks and last merges."""

    def __init__(self, path: str) -> None:
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        kind = model.SentencePiece.Type
        if train.model_type != train.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: not a plain BPE model with byte fallback")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError(f"{path}: a model that rewrites characters")
        normal = [p for p in model.pieces if p.type == kind.NORMAL]
        place = {score: i for i, score in enumerate(sorted({p.score for p in normal}, reverse=True))}
        #: Lower ranks merge first.
        self.rank = {p.piece: place[p.score] for p in normal}
        self.longest = max(map(len, self.rank))
        if self.longest > 31:
            raise ValueError(f"{path}: steps of pieces of {self.longest} characters don't fit a byte")
        #: Pieces that their own characters merge to, with the last two parts; no others ever come out.
        self.parts = {p: parts for p in self.rank if (parts := self._last_merge(p)) is not None}
        if any(self.rank[x] > self.rank[p] for p, parts in self.parts.items() for x in parts if len(x) > 1):
            raise ValueError(f"{path}: a piece that is made of later ones")
        inner = {c for p in self.rank for c in p}
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in inner)
        if any(b == SPACE != a for p in self.rank for a, b in pairwise(p)):
            self.words = re.compile("(?s).+")
        else:
            self.words = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        #: All ends of pieces.
        self.tails = {p[i:] for p in self.parts for i in range(len(p))}
        #: By left piece, which right ones fit behind it.
        self.seams: dict[str, dict[str, bool]] = {}
        self.n_seams = 0
        #: Words solved lately, and those of the memory before it, of which words asked again come back.
        self.memory: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}

    def _last_merge(self, piece: str) -> tuple[str, ...] | None:
        """The two parts that a piece is last merged from, () for a single character, None if its characters don't end up as it."""
        parts, last = list(piece), ()
        while len(parts) > 1:
            found = [(rank, i) for i, (a, b) in enumerate(pairwise(parts)) if (rank := self.rank.get(a + b)) is not None]
            if not found:
                return None
            i = min(found)[1]
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return last

    def fits(self, left: str, right: str) -> bool:
        """Whether no merge crosses the seam of two neighbouring pieces.

        At the end the two pieces face each other. Their merges are undone from the latest back; of two of one rank the
        right one came later. What the facing parts would join to must not have come before the merge undone just now.
        """
        rank, parts = self.rank, self.parts
        cross, until = rank.get(left + right), None
        while cross is None or (until is not None and cross >= until):
            a, b = parts.get(left) or None, parts.get(right) or None
            if a is None and b is None:
                return True
            if b is None or (a is not None and rank[left] > rank[right]):
                until, left = rank[left], a[1]
            else:  # a join across the seam lies further left and so goes before a merge of its own rank here
                until, right = rank[right] + 1, b[0]
            cross = rank.get(left + right)
        return False

    def _solve(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its steps. Words come sorted, so what they begin with alike is solved once."""
        parts, tails = self.parts, self.tails
        counts, ends, steps, before = [0], [("", {})], bytearray(), ""
        for word in words:
            same = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                same += 1
            del counts[same + 1 :], ends[same + 1 :], steps[same:]
            for i in range(same + 1, len(word) + 1):
                found = []
                for j in range(i - 1, -1, -1):
                    piece = word[j:i]
                    if piece not in tails:
                        break
                    if piece in parts:
                        found.append((j, piece))
                for j, piece in reversed(found):
                    if j:
                        left, told = ends[j]
                        if (fits := told.get(piece)) is None:
                            fits = told[piece] = self.fits(left, piece)
                            self.n_seams += 1
                        if not fits:
                            continue
                    counts.append(counts[j] + 1)
                    break
                else:  # a character that the model doesn't have is written as its bytes
                    piece = word[i - 1]
                    counts.append(counts[i - 1] + len(piece.encode()))
                ends.append((piece, self.seams.setdefault(piece, {})))
                steps.append((counts[i] - counts[i - 1]) & 255)
            yield word, bytes(steps)
            before = word
        if self.n_seams > MEMORY_SEAMS:
            self.seams.clear()
            self.n_seams = 0

    def steps(self, texts: list[str]) -> list[bytes]:
        """For each text a signed byte a character, behind a first one for the space that the model puts before it; empty for an empty text."""
        split = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        words = set().union(*split)
        if len(self.memory) + len(words) > MEMORY_WORDS:
            self.former, self.memory = self.memory, {}
        known, former = self.memory, self.former
        known.update((w, former[w]) for w in (words - known.keys()) & former.keys())
        fresh = words - known.keys()
        known.update(self._solve(sorted(fresh)))
        out = [b"".join(map(known.__getitem__, ws)) for ws in split]
        for word in fresh:
            if len(word) > MEMORY_CHARS:
                del known[word]
        return out


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def counts(steps: bytes) -> np.ndarray:
    """Token counts of all prefixes, from the empty one to the whole text."""
    out = np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)
    if not len(out):
        return np.zeros(1, np.int64)
    out[0] = 0  # the space before the text comes with its first character
    return out


def longest_within(of_prefixes: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most so many tokens."""
    return int(np.flatnonzero(of_prefixes <= max(budget, 0))[-1])


def store(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with ``n_bytes``, ``n_chars`` and ``prefixes``, the compressed steps of the counts of all prefixes."""
    bound_batches(docs.sparkSession)
    own = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(*own, F.col("text").cast("string").alias("text"))
    schema = T.StructType([*(f for f in rows.schema if f.name != "text"), T.StructField("n_bytes", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("prefixes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, press = pieces(path), zstandard.ZstdCompressor(level=1)
        for block in blocks(batches, "text", BLOCK_BYTES):
            raw = utf8(block, "text")
            texts = [b.decode() for b in raw]
            made = [press.compress(s) for s in model.steps(texts)]
            new = {"n_bytes": pa.array(map(len, raw), pa.int64()), "n_chars": pa.array(map(len, texts), pa.int64()), "prefixes": pa.array(made, pa.binary())}
            yield from pa.table({c: block.column(c) for c in block.column_names if c != "text"} | new).to_batches()

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "n_chars", "prefixes")


def _questions(kind: str):
    """A function of stored prefixes and a number, evaluated over Arrow batches."""

    @F.arrow_udf("long")
    def ask(prefixes: pa.Array, number: pa.Array) -> pa.Array:
        press, out = zstandard.ZstdDecompressor(), []
        for stored, n in zip(prefixes.to_pylist(), number.to_pylist(), strict=True):
            at = counts(press.decompress(stored)) if stored is not None else np.zeros(1, np.int64)
            out.append(longest_within(at, n or 0) if kind == "fit" else int(at[min(max(n or 0, 0), len(at) - 1)]))
        return pa.array(out, pa.int64())

    return ask


def tokens_at(prefixes: Column, n_chars: Column) -> Column:
    """Tokens of the prefix of so many characters, from the stored prefixes."""
    return _questions("at")(prefixes, n_chars.cast("long"))


def fit(prefixes: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most so many tokens, from the stored prefixes."""
    return _questions("fit")(prefixes, budget.cast("long"))


def answer(stored: DataFrame, budget: int) -> DataFrame:
    """Replaces ``prefixes`` by ``n_tokens``, ``over_limit`` and ``fit_chars``, the longest prefix within the budget."""
    rest = [c for c in stored.columns if c != "prefixes"]
    asked = stored.select(*rest, tokens_at(F.col("prefixes"), F.col("n_chars")).alias("n_tokens"), fit(F.col("prefixes"), F.lit(budget)).alias("fit_chars"))
    return asked.select(*rest, "n_tokens", (F.col("n_tokens") > budget).alias("over_limit"), "fit_chars")
