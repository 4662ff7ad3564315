"""Line sequence labelling: a conditional random field marks each line as content or boilerplate.

A document's lines are its text cut at line feeds. The field is fitted on a bounded sample of labelled documents
(``SAMPLE_DOCS`` of each quality): lines of good documents are content and lines of bad ones boilerplate, except
that a line which says again what an earlier line said is boilerplate anywhere. Viterbi
decoding labels all lines of every whole text; a document is kept if at least half of its words stand in content
lines; of two paths of equal score Viterbi takes that of boilerplate.

Null or empty text has no words and is not kept. Repeated rows give equal rows; an empty table gives none, and empty
labels a plain prior. Very long texts are read whole, a block each. Only doc_id and text, and the labels' doc_id and
quality, are read; other columns are free to have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bound_batches, utf8
from .crf import Crf, fit, viterbi

#: Labelled documents of each quality that the field is fitted on, at most, and the longest of them in characters.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 20_000
BLOCK_BYTES = 4 << 20
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_CONTENT = 10, 20, 0.5
SYMBOLS = b"#*$%&|<>"
NOTICE = re.compile(rb"licen[sc]ed? |copyright|all rights reserved|cookie|subscribe|click here|terms of (?:use|service)|privacy policy", re.I)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and c not in b".,;:'\"-()"]] = True
_BAR = np.zeros(256, bool)
_BAR[ord("|")] = True
_POINT = np.zeros(256, bool)
_POINT[list(b".!?:;\"')")] = True


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Counts of true bytes between consecutive bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts by document, and the lines' features in order with the number of lines of each document."""
    n_lines = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(raw == 10)
    line_bounds = np.concatenate([[0], ends + 1])
    last = np.cumsum(n_lines)
    doc_bounds = line_bounds[np.concatenate([[0], last])]
    space = _SPACE[raw]
    solid = ~space
    starts = solid.copy()
    starts[1:] &= space[:-1]
    chars = solid & ((raw & 0xC0) != 0x80)
    words = _sums(starts, line_bounds)
    solids = np.maximum(_sums(chars, line_bounds), 1)
    per = lambda flags: _sums(flags[raw], line_bounds) / solids
    repeated, notice = np.zeros(len(words), bool), np.zeros(len(words), bool)
    n_dup = np.zeros(len(texts), np.int64)
    at = 0
    for k, text in enumerate(texts):
        if n_lines[k] > 1:
            seen: set[bytes] = set()
            for i, line in enumerate(text.split(b"\n"), at):
                if words[i]:
                    if line in seen:
                        repeated[i] = True
                        n_dup[k] += 1
                    else:
                        seen.add(line)
        at += int(n_lines[k])
    if NOTICE.search(joined):
        for m in NOTICE.finditer(joined):
            notice[np.searchsorted(line_bounds, m.start(), "right") - 1] = True
    stops = np.maximum(line_bounds[1:] - 2, line_bounds[:-1])
    marks = per(_MARK)
    features = np.stack([
        np.ones(len(words)), np.log1p(words) / 5, words == 0, np.minimum(marks * 5, 1.5), np.minimum(per(_SYMBOL) * 5, 1.5),
        np.minimum(per(_UPPER) * 2, 1.5), np.minimum(per(_DIGIT) * 3, 1.5), np.minimum(per(_BAR) * 8, 1.5), _POINT[raw[stops]],
        _UPPER[raw[line_bounds[:-1]]], np.minimum(solids / np.maximum(words, 1) / 10, 2), repeated, notice,
    ], 1).astype(np.float64)
    return {
        "n_words": np.add.reduceat(words, last - n_lines), "word_chars": _sums(chars, doc_bounds), "n_symbols": _sums(_SYMBOL[raw], doc_bounds),
        "n_dup_lines": n_dup, "n_repeat_words": _repeat_words(texts), "n_lines": n_lines, "line_words": words, "features": features, "plain_bad": repeated,
    }


def _repeat_words(texts: list[bytes]) -> np.ndarray:
    """By document, the words that stand in a window of five words which the document has more than once."""
    number: dict[bytes, int] = {}
    counts, ids = np.zeros(len(texts), np.int64), []
    for k, text in enumerate(texts):
        words = text.split()
        counts[k] = len(words)
        ids += [number.setdefault(w, len(number)) for w in words]
    out = np.zeros(len(texts), np.int64)
    word = np.array(ids, np.uint64)
    if len(word) <= WINDOW:
        return out
    doc = np.repeat(np.arange(len(texts)), counts)
    n = len(word) - WINDOW + 1
    code = doc[:n].astype(np.uint64)
    for i in range(WINDOW):
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word[i : n + i]
    code ^= code >> np.uint64(32)
    code *= np.uint64(0x94D049BB133111EB)
    inside = doc[:n] == doc[WINDOW - 1 :]
    ordered = np.sort(code[inside])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return out
    # A small bitmap picks the windows worth a closer look; equal codes are then compared word by word.
    hit = np.zeros(1 << 20, bool)
    hit[(twice >> np.uint64(44)).astype(np.int64)] = True
    look = np.flatnonzero(inside & hit[(code >> np.uint64(44)).astype(np.int64)])
    look = look[np.lexsort((look, code[look]))]
    windows = np.stack([doc[look].astype(np.uint64), *(word[look + i] for i in range(WINDOW))], 1)
    same = (windows[1:] == windows[:-1]).all(1) & (code[look[1:]] == code[look[:-1]])
    found = look[np.r_[same, False] | np.r_[False, same]]
    edge = np.zeros(len(word) + 1, np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(texts)).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame) -> Crf:
    """Fit the field on a bounded sample of labelled documents; without any, on a plain prior."""
    marks = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1)").dropDuplicates(["label_id"])
    chosen = [marks.filter(F.col("quality") == q).orderBy(F.xxhash64("label_id"), "label_id").limit(SAMPLE_DOCS) for q in (0, 1)]
    rows = (
        docs.select("doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(chosen[0].union(chosen[1])), F.col("doc_id") == F.col("label_id"))  # at most 2 * SAMPLE_DOCS rows
        .select("doc_id", "text", "quality").orderBy("doc_id", "text").limit(2 * SAMPLE_DOCS).collect()
    )
    if not rows:
        return prior()
    seen = measure([r["text"].encode() for r in rows])
    quality = np.repeat([r["quality"] for r in rows], seen["n_lines"])
    y = ((quality == 1) & ~seen["plain_bad"]).astype(np.int64)
    return fit(seen["features"], y, seen["n_lines"])


def prior() -> Crf:
    """What is assumed without labelled documents: marks, capitals, bars, repeats and notices speak against a line."""
    weights = np.zeros((13, 2))
    weights[[3, 4, 5, 7, 11, 12], 0] = [2, 4, 3, 4, 4, 4]
    weights[0, 1] = 2
    return Crf(weights, np.array([[0.5, 0.0], [0.0, 0.5]]))


def label_documents(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, counts, content_share (of words in content lines), base_failed and kept for every document."""
    bound_batches(docs.sparkSession)
    frame = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean, n_lines long, content_share double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            seen = measure(utf8(block, "text"))
            labels = viterbi(model, seen["features"], seen["n_lines"])
            firsts = np.cumsum(seen["n_lines"]) - seen["n_lines"]
            content = np.add.reduceat(seen["line_words"] * labels, firsts)
            n = seen["n_words"]
            share = content / np.maximum(n, 1)
            failed = (n < MIN_WORDS) | (100 * seen["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
            yield from pa.table({
                "doc_id": block.column("doc_id"), **{c: pa.array(seen[c], pa.int64()) for c in counts},
                "base_failed": failed, "kept": ~failed & (share >= MIN_CONTENT), "n_lines": seen["n_lines"], "content_share": share,
            }).combine_chunks().to_batches()

    return frame.mapInArrow(run, schema)
