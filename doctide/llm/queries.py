"""The corpus operators as registered queries, applied to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, html_text, jpeg, kneser_ney, language, line_quality, mixing, near_dup, pii, token_counts, warc, whitening
from .common import crc_bucket, table


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_quality.label_documents(docs, line_quality.train(docs, table(spark, sf_dir, "labels")))


def op2_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.describe(jpeg.store_text(table(spark, sf_dir, "documents"))).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    dictionaries = language.learn(docs.filter("NOT held_out AND doc_id IS NOT NULL"))
    return language.predict(docs, dictionaries, ("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score", "margin", "accepted")


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    weights = mixing.ranked_weights(docs.select("source").distinct(), (5.0, 2.0, 1.0))
    return mixing.mix(sized, weights, share=1.5, max_epochs=2.0).select("doc_id", "size", "source_size", "target", "taken", "repeats")


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    index = warc.build_index(warc.write(pages))
    return warc.fetch(spark, index, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = token_counts.store(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.answer(stored, 4096).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_quality": op1_line_quality,
    "op2_jpeg": op2_jpeg,
    "op3_bpe": op3_bpe,
    "op4_language": op4_language,
    "op5_near_dup": op5_near_dup,
    "op6_mixing": op6_mixing,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_pii": op8_pii,
    "op9_html_text": op9_html_text,
    "op10_warc": op10_warc,
    "op11_whitening": op11_whitening,
    "op12_token_counts": op12_token_counts,
    "op13_collocations": op13_collocations,
}

_PAGES = """
p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS s FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY n, s) AS owner FROM p),
b AS (SELECT *, [('0x' || substr(s, i * 5 + 1, 5))::BIGINT FOR i IN range(8)] AS q FROM o)"""

ORACLE_SQL: dict[str, str] = {
    # Base 32 takes 20 bits, four letters, from every five hex digits.
    "op10_warc": f"""WITH {_PAGES}
SELECT page_id, n AS payload_bytes,
  array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> k) & 31)::INT + 1, 1) FOR k IN [15, 10, 5, 0]], '') FOR x IN q], '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to FROM b""",
    "op6_mixing": r"""WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS position FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source),
f AS (
  SELECT 0 AS round, 1.5 * sum(source_size)::DOUBLE / sum(weight) AS level FROM s
  UNION ALL
  SELECT f.round + 1, (SELECT (1.5 * sum(source_size) - sum(CASE WHEN weight * f.level >= 2.0 * source_size THEN 2.0 * source_size ELSE 0 END))::DOUBLE / nullif(sum(CASE WHEN weight * f.level < 2.0 * source_size THEN weight END), 0) FROM s)
  FROM f WHERE f.round < 60 AND f.level IS NOT NULL),
t AS (
  SELECT source, source_size, round(least(2.0 * source_size, weight * (SELECT max(level) FROM f)), 6)::DOUBLE AS target FROM s),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
x AS (
  SELECT d.doc_id, d.size, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS extra,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.position, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.position >> 36) AS through
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target, (size * r)::BIGINT AS taken, r::BIGINT AS repeats
FROM (SELECT *, whole + CASE WHEN through <= extra OR before + size / 2.0 <= extra THEN 1 ELSE 0 END AS r FROM x)""",
    "op13_collocations": r"""WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (SELECT lang, k, unnest([words[i : i + k - 1] FOR i IN range(1, len(words) - k + 2)]) AS ids FROM w, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(words) >= k),
f AS (SELECT lang, ids, count(*)::HUGEINT AS a FROM g GROUP BY lang, ids),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE len(ids) = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE len(ids) > 1 AND a >= 10),
longer AS (SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest([ids[1:2], ids[2:3]]) AS part FROM c WHERE len(ids) = 3) GROUP BY lang, part),
kept AS (SELECT c.* FROM c LEFT JOIN longer ON c.lang = longer.lang AND c.ids = longer.part WHERE longer IS NULL OR 100 * longer < 50 * a),
cuts AS (SELECT lang, ids, a, k FROM kept, (VALUES (1), (2)) AS cuts(k) WHERE k < len(ids)),
s AS (
  SELECT cuts.lang, cuts.ids, cuts.a, k, x.a AS l, y.a AS r, 1000000 * cuts.a * cuts.a // (x.a * y.a) AS score
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.ids = cuts.ids[1 : k] JOIN f AS y ON y.lang = cuts.lang AND y.ids = cuts.ids[k + 1 : len(cuts.ids)]),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, ids ORDER BY score, k) AS cut, array_to_string(ids, ' ') AS phrase FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE cut = 1)
SELECT t.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM t JOIN n ON t.lang = n.lang WHERE rank <= 2000""",
}
