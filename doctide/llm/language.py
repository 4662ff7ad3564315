"""Language by compression: the raw-content dictionary that makes a text smallest names its language.

Dictionaries hold text of a bounded sample of labelled documents: for each language, in the order of a hash of the id
with documents of up to ``SHORT`` characters first, as many as fill ``DICTIONARY_BYTES``, in lower case. Every language
that a labelled text has is learned, however many there are and however long their texts. Every whole text,
lower-cased, is compressed once with each dictionary. The margin is how much smaller the best result is than the next;
``accepted`` is false where it is narrower than ``MIN_MARGIN`` or nothing could be learned.

A text that is null or has no letter is ``und`` with score 0 and not accepted; so is every text when no labelled row
exists. Ties go to the language that comes first by code point. Rows without text or language aren't learned from, and
empty texts name no language. Repeated rows are learned from as often as they come and give equal predictions; an empty
table gives no rows. Only the named columns are read; those of ``keep`` may not be called lang_pred, score, margin or
accepted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, bound_batches

#: Bytes of a dictionary, which bounds the sample of each language; at most ROWS rows of one go into it.
DICTIONARY_BYTES, ROWS = 110 << 10, 400
#: Longer documents are learned from only where shorter ones don't fill the dictionary.
SHORT = 8_000
LEVEL = 6
MIN_MARGIN = 0.02
BLOCK_BYTES = 4 << 20


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, bytes]:
    """Dictionary bytes by language, from a bounded sample that a hash of the id picks."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col).alias("pick")).filter("lang IS NOT NULL AND length(text) > 0")
    rows = rows.withColumn("long", F.length("text") > SHORT)
    counts = rows.groupBy("lang", "long").agg(F.count("*").alias("n"))
    # A share of each language's rows that holds about twice the sample, by the hash, before any of them meet.
    share = counts.select(F.col("lang").alias("of"), F.col("long").alias("of_long"), F.least(F.lit(1.0), (2 * ROWS + 50) / F.col("n")).alias("share"))
    near = rows.join(share, (F.col("lang") == F.col("of")) & (F.col("long") == F.col("of_long"))).filter(F.pmod("pick", F.lit(1 << 30)) / (1 << 30) < F.col("share"))
    # No more of a text's end than a dictionary can hold travels on.
    near = near.select("lang", "long", "pick", F.substring("text", -DICTIONARY_BYTES, DICTIONARY_BYTES).alias("text"))
    order = Window.partitionBy("lang").orderBy("long", "pick", "text")
    before = F.sum(F.octet_length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= ROWS).withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < DICTIONARY_BYTES)
    held: dict[str, list[str]] = {}
    for r in first.orderBy("lang", "n").select("lang", "text").toLocalIterator():  # about DICTIONARY_BYTES a language
        held.setdefault(r["lang"], []).append(r["text"])
    return {lang: "\n".join(reversed(texts)).lower().encode()[-DICTIONARY_BYTES:] for lang, texts in sorted(held.items())}


def predict(docs: DataFrame, dictionaries: dict[str, bytes], keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep``, lang_pred, score (0 to 1), margin and accepted for every row."""
    bound_batches(docs.sparkSession)
    frame = docs.select(*keep, docs[text_col].cast("string").alias("__text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema if f.name != "__text") + "lang_pred string, score double, margin double, accepted boolean"
    langs = sorted(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makers = []
        for lang in langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            makers.append(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))
        for block in blocks(batches, "__text", BLOCK_BYTES):
            texts = [t or "" for t in block.column("__text").to_pylist()]
            known = np.array([bool(langs) and any(map(str.isalpha, t)) for t in texts], bool)
            raw = [t.lower().encode() if k else b"" for t, k in zip(texts, known.tolist(), strict=True)]
            sizes = np.array([[len(m.compress(t)) if t else 1 for t in raw] for m in makers] or [[1] * len(raw)], float)
            best = sizes.argmin(0)
            top = sizes.min(0)
            rest = np.sort(sizes, 0)[1] if len(langs) > 1 else np.array([max(len(t), 1) for t in raw], float)
            margin = np.where(known, np.maximum(rest - top, 0) / np.maximum(rest, 1), 0.0)
            score = np.where(known, 0.5 + 0.5 * np.minimum(margin / 0.25, 1.0), 0.0)
            names = [langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            yield from pa.table({**{c: block.column(c) for c in keep}, "lang_pred": pa.array(names, pa.string()), "score": score, "margin": margin, "accepted": known & (margin >= MIN_MARGIN)}).combine_chunks().to_batches()

    return frame.mapInArrow(run, schema)
