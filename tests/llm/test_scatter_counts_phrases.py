"""Whitening, token counts and phrases against brute force, on small tables with nulls, repeats, ties and hostile values."""

import collections
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from doctide.llm import collocations, queries, token_counts, whitening

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["the ", "ing", "ed", " ", "  ", "▁", "\n", "é", "é", "😀", "<s>", "</s>", "<0x0A>", "aaa", "\t", "0", "12", "\x00", "ß", "中文", "ll", "l", "re", "tion", " of", "\x85"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_counts_of_every_prefix(library):
    rng, model = random.Random(2), token_counts.pieces(MODEL)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 20))) for _ in range(400)]
    for text, steps in zip(texts, model.steps(texts), strict=True):
        assert token_counts.counts(steps).tolist() == [len(library.encode(text[:i])) for i in range(len(text) + 1)], text


def test_counts_of_long_runs_and_a_full_memory(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMORY_WORDS", 3)
    monkeypatch.setattr(token_counts, "MEMORY_SEAMS", 3)
    model = token_counts.Pieces(MODEL)
    texts = ["a" * 4000, " " * 4000, "ab" * 3000, "the cat sat on the mat", "x\n" * 500, "", "z" * 70 + " z" * 70]
    for _ in range(2):
        assert [int(token_counts.counts(s)[-1]) for s in model.steps(texts)] == [len(library.encode(t)) for t in texts]
    assert not any(len(w) > token_counts.MEMORY_CHARS for w in model.memory)


def test_stored_counts_answer_questions(spark, library):
    long = "night and day " * 3000
    rows = [(1, "one two three", 7), (2, None, 7), (3, "", 7), (1, "one two three", 7), (None, " \tx", 7), (5, long, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    stored = token_counts.store(docs, MODEL)
    out = token_counts.answer(stored, 2).collect()
    assert len(out) == len(rows)
    for r in out:
        text = next(t or "" for i, t, _ in rows if i == r["doc_id"])
        sizes = [len(library.encode(text[:i])) for i in range(min(len(text), 60) + 1)]
        assert (r["n_bytes"], r["n_chars"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), len(text), len(library.encode(text)), len(library.encode(text)) > 2)
        assert r["fit_chars"] == max(i for i, n in enumerate(sizes) if n <= 2)
    asked = stored.select("doc_id", *[token_counts.tokens_at(F.col("prefixes"), F.lit(n)).alias(f"at{i}") for i, n in enumerate((-1, 0, 5, 10**6))], token_counts.fit(F.col("prefixes"), F.lit(-3)).alias("none")).collect()
    for r in asked:
        text = next(t or "" for i, t, _ in rows if i == r["doc_id"])
        assert (r["at0"], r["at1"], r["at2"], r["at3"], r["none"]) == (0, 0, len(library.encode(text[:5])), len(library.encode(text)), 0)
    # Text cut to a budget without encoding it again.
    cut = token_counts.answer(token_counts.store(docs, MODEL, ("doc_id", "text")), 5).select(F.left("text", "fit_chars").alias("t"), "fit_chars").collect()
    assert all(len(library.encode(r["t"] or "")) <= 5 for r in cut)
    assert token_counts.answer(token_counts.store(docs.limit(0), MODEL), 2).collect() == []


def test_token_counts_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op12_token_counts(spark, sf).collect()
    assert len(out) == len(text)
    for r in out:
        n = len(library.encode(text[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text[r["doc_id"]].encode()), n, n > 4096)


def test_scatter_is_exact():
    rng = np.random.default_rng(1)
    wide = np.array([[-(2**63), 2**63 - 1, 5], [2**63 - 1, -(2**63), 5], [0, 1, 5]])
    for x in [rng.integers(-9, 9, (1, 3)), rng.integers(-300, 300, (200, 5)), rng.integers(-(2**62), 2**62, (70, 3)), np.full((65, 2), 7), wide]:
        sums, cross = whitening.scatter(x)
        exact = x.astype(object)
        assert sums.tolist() == exact.sum(axis=0).tolist() and cross.tolist() == (exact.T @ exact).tolist()


def _expected(vectors, components=4):
    x = np.floor(256 * np.array(vectors, np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ vectors / np.sqrt(values), values / (centred.T @ centred / n).trace()


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 8)) @ rng.normal(size=(8, 8))).astype(np.float32).tolist()
    vectors = vectors + vectors[:40] + [vectors[0]] * 200
    odd = [(9001, None), (9002, [1.0] * 7 + [None]), (9003, [float("nan")] * 8), (9004, [float("-inf")] * 8), (9005, [1.0, 2.0]), (9006, [])]
    rows = [(i, v, 1.0) for i, v in enumerate(vectors)] + [(i, v, 1.0) for i, v in odd]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened double").repartition(3)
    out = sorted(whitening.whiten(frame).collect(), key=lambda r: (r["vec_id"], r["component"]))
    n, deviation, whitened, explained = _expected(vectors)
    assert [(r["vec_id"], r["component"]) for r in out] == [(i, k) for i in range(len(vectors)) for k in (1, 2, 3, 4)]
    assert all(r["n"] == n == 300 and r["deviation"] == deviation[r["vec_id"]] for r in out)
    got = np.array([r["whitened"] for r in out]).reshape(-1, 4)
    assert np.abs(got * np.sign((got * whitened).sum(axis=0)) - whitened).max() < 1e-9
    assert np.allclose([r["explained"] for r in out[:4]], explained, rtol=1e-9) and out[0]["identity_error"] < 1e-9


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], schema)).collect() == []
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(1, 0, None, None, None)] * 4
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1e30]), (3, [-1e30, -1e30])], schema)).collect()
    assert len(huge) == 6 and all(r["deviation"] is None and abs(r["whitened"]) < 2 for r in huge)


def test_whitening_query_equals_numpy(spark):
    sf = "/root/testdata/sf0.001"
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = sorted(vectors)
    n, deviation, whitened, explained = _expected([vectors[i] for i in ids])
    out = sorted(queries.op11_whitening(spark, sf).collect(), key=lambda r: (r["vec_id"], r["component"]))
    got = np.array([r["whitened"] for r in out]).reshape(-1, 4)
    assert [r["deviation"] for r in out[::4]] == deviation.tolist() and out[0]["n"] == n
    assert np.abs(got * np.sign((got * whitened).sum(axis=0)) - whitened).max() < 1e-9


def _phrases(rows, longest, support, top):
    found, n = collections.defaultdict(collections.Counter), collections.Counter()
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                found[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in found.items():
        inside = {p[i : i + k] for p, a in f.items() if len(p) > 2 and a >= support for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 50 * f[p[i : i + k]]}
        scored = []
        for p, a in f.items():
            if len(p) > 1 and a >= support and p not in inside:
                score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("longest", [1, 2, 3, 4])
def test_phrases_equal_brute_force(spark, monkeypatch, longest):
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 300)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 40)
    rng = random.Random(longest)
    parts = ["x ", "Y ", "y ", "É ", ". ", "\t", "zz", "\n", "\x00 ", "\x85", "  ", "q,", "  "]
    rows = [(rng.choice(["a", None, ""]), "".join(rng.choices(parts, k=rng.randint(0, 120)))) for _ in range(300)]
    rows += rows[:20] + [(None, None), ("b", ""), ("c", "solo solo " * 400), ("d", "no phrase here")]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "lang string, text string, a int, score double").repartition(3)
    assert sorted(tuple(r) for r in collocations.mine(docs, longest=longest, top=40).collect()) == _phrases(rows, longest, 10, 40)


def test_phrases_of_an_empty_table(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations.mine(spark.createDataFrame([(None, None)], "lang string, text string")).collect() == []


def test_phrase_scores_beyond_64_bits(spark):
    a, left, right = 3_000_000_019, 4_000_000_007, 5_000_000_029
    row = spark.range(1).select(collocations._score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()
    assert row["s"] == 1_000_000 * a * a // (left * right)
