"""Each operator on small tables with nulls, empty and repeated rows, against brute force or a round trip."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

from doctide.llm.crf import Crf, viterbi
from doctide.llm import bpe, html_text, jpeg, kneser_ney, language, line_quality, mixing, near_dup, pii, warc

WORDS = "the of and river stone house light cloud walks under bright seven letters carry wind over field moon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, N_WORDS int"
LABELS = "doc_id long, quality int, toxic int"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [sentence(rng, 60) + "\n" + sentence(rng, 40) for _ in range(12)]
    texts = [*base, *base[:3], base[4].replace("river", "RIVER", 1) + " end", base[5] + " more words", None, "", "one two", "a b c d e", " \t\n", "x" * 50_000, "é😀 ²½一 " * 50]
    return [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None][i % 3], 0, True, 1) for i, t in enumerate(texts)] + [(0, base[0], "en", "s1", 0, True, 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(12)] + [(None, 1, 0)], LABELS)


def test_bpe_equals_tiktoken(docs, empty, rows):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.encode(docs, path, public_tokenizers.PATTERN, ("ids", "n_tokens", "decoded", "ids_sha256", "decoded_sha256")).collect()
    text = {r[0]: r[1] or "" for r in rows}
    for r in out:
        assert r["ids"] == oracle.encode_ordinary(text[r["doc_id"]]) and bytes(r["decoded"]).decode() == text[r["doc_id"]]
        packed = b"".join(i.to_bytes(4, "little") for i in r["ids"])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(r["ids"]), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text[r["doc_id"]].encode()).hexdigest())
    assert bpe.encode(docs.filter("text IS NULL"), path, public_tokenizers.PATTERN).first()["ids"] == []
    assert len(out) == len(rows) and bpe.encode(empty, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_words_of_several_chunks(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    table, rng = bpe.ranks(path), random.Random(5)
    words = ["".join(rng.choices("abé ²一\n", k=rng.randint(2, 9))) for _ in range(40)]
    asked = {key: set(rng.sample(words, 25)) for key in (0, 1, 1 << 32)}
    rows = [(key, bytearray(w.encode())) for key, held in asked.items() for w in held]
    folder = f"file://{tmp_path}/ids"
    bpe.merge_words(spark.createDataFrame(rows, "key long, word binary"), path).repartition("key").write.partitionBy("key").parquet(folder)
    for key, held in asked.items():
        order = sorted(held)
        assert bpe._told(folder, key, table) == dict(zip(order, bpe.replay([w.encode() for w in order], table), strict=True))
    assert bpe._told(folder, 7, table) == {}


def test_bpe_replay_on_runs():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["a" * 999, " " * 777, "ab" * 500, "".join(rng.choices("ab aé\n\t ²½一x's12\x1c\x85　😀A", k=4000))]
    got = bpe.Coder(path, public_tokenizers.PATTERN).encode(texts)
    assert [list(memoryview(x).cast("I")) for x in got] == [oracle.encode_ordinary(t) for t in texts]


def test_jpeg_round_trip(docs, empty, rows):
    out = {r["doc_id"]: r for r in jpeg.describe(jpeg.store_text(docs)).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        padded = raw + b"\0" * ((64 - len(raw)) if len(raw) < 64 else -len(raw) % 64)
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert jpeg.describe(jpeg.store_text(empty)).count() == 0


def test_jpeg_broken_media(spark):
    media = spark.createDataFrame([(1, None), (2, bytearray(b"no")), (3, bytearray(jpeg.carry([b"k" * 128])[0][:-20]))], "doc_id long, media binary")
    assert all(r["error"] for r in jpeg.describe(media).collect())


class Bits:
    """A plain bit writer with stuffing, for a coder of its own."""

    def __init__(self):
        self.out = ""

    def put(self, value, n):
        self.out += format(value, f"0{n}b") if n else ""

    def done(self):
        bits = self.out + "1" * (-len(self.out) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


#: Twelve DC codes of four bits, and all AC symbols in codes of eight.
DC_COUNTS, DC_SYMBOLS = [0, 0, 0, 12] + [0] * 12, list(range(12))
AC_SYMBOLS = [0, 0xF0] + [r << 4 | z for r in range(16) for z in range(1, 11)]
AC_COUNTS = [0] * 7 + [len(AC_SYMBOLS)] + [0] * 8


def coded(bits, block, before):
    def number(v, size):
        bits.put(v if v > 0 else v + (1 << size) - 1, size)

    step = int(block[0]) - before
    size = abs(step).bit_length()
    bits.put(DC_SYMBOLS.index(size), 4)
    number(step, size)
    run = 0
    for v in map(int, block[1:]):
        if not v:
            run += 1
            continue
        while run > 15:
            bits.put(AC_SYMBOLS.index(0xF0), 8)
            run -= 16
        size = abs(v).bit_length()
        bits.put(AC_SYMBOLS.index(run << 4 | size), 8)
        number(v, size)
        run = 0
    if run:
        bits.put(AC_SYMBOLS.index(0), 8)
    return int(block[0])


def jpeg_file(width, height, sampling, grids, together, restart):
    """A file of components with block grids (rows, columns, 64), in one scan or in one each."""
    seg = lambda kind, body: bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body
    out = b"\xff\xd8" + seg(0xDB, b"\0" + bytes(range(1, 65)))
    out += seg(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(sampling)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    out += seg(0xC4, b"\0" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)) + seg(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS)) + seg(0xDD, restart.to_bytes(2, "big"))
    top_h, top_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    for comps in [range(len(sampling))] if together else [[i] for i in range(len(sampling))]:
        if together:
            units = [[(i, y * sampling[i][1] + b, x * sampling[i][0] + a) for i in comps for b in range(sampling[i][1]) for a in range(sampling[i][0])] for y in range(-(-height // (8 * top_v))) for x in range(-(-width // (8 * top_h)))]
        else:
            (i,), (h, v) = comps, sampling[comps[0]]
            units = [[(i, y, x)] for y in range(-(-(-(-height * v // top_v)) // 8)) for x in range(-(-(-(-width * h // top_h)) // 8))]
        parts = []
        for at in range(0, len(units), restart or len(units)):
            bits, before = Bits(), collections.Counter()
            for unit in units[at : at + (restart or len(units))]:
                for i, y, x in unit:
                    before[i] = coded(bits, grids[i][y, x], before[i])
            parts.append(bits.done())
        body = parts[0] + b"".join(b"\xff" + bytes([0xD0 + n % 8]) + p for n, p in enumerate(parts[1:]))
        out += seg(0xDA, bytes([len(comps)]) + b"".join(bytes([i + 1, 0]) for i in comps) + bytes([0, 63, 0])) + body
    return out + b"\xff\xd9"


@pytest.mark.parametrize("together", [True, False])
@pytest.mark.parametrize("restart", [0, 3])
def test_jpeg_of_another_coder(spark, together, restart):
    rng = np.random.default_rng(4)
    files, expected = [], []
    for width, height, sampling in [(37, 29, [(2, 2), (1, 1), (1, 1)]), (16, 9, [(1, 1)]), (50, 33, [(2, 1), (1, 1), (1, 1)])]:
        top_h, top_v = max(h for h, _ in sampling), max(v for _, v in sampling)
        across, down = -(-width // (8 * top_h)), -(-height // (8 * top_v))
        grids = []
        for h, v in sampling:
            grid = np.zeros((down * v, across * h, 64), np.int64)
            grid[..., 0] = rng.integers(-200, 200, grid.shape[:2])
            grid[..., 1:] = rng.integers(-1000, 1000, (*grid.shape[:2], 63)) * (rng.random((*grid.shape[:2], 63)) < 0.08)
            grids.append(grid)
        files.append(jpeg_file(width, height, sampling, grids, together, restart))
        expected.append((width, height, sampling, grids))
    for im, (width, height, sampling, grids) in zip(jpeg.read(files), expected, strict=True):
        assert not im.error
        top_h, top_v = max(h for h, _ in sampling), max(v for _, v in sampling)
        shown = np.clip((grids[0][..., 0] + 4 >> 3) + 128, 0, 255)[: -(-height * sampling[0][1] // (8 * top_v)), : -(-width * sampling[0][0] // (8 * top_h))]
        assert (jpeg.thumbnail(im) == shown).all()
        for c, (h, v) in enumerate(sampling):
            grid = grids[c]
            if not together and len(sampling) > 1:  # a scan of its own doesn't reach beyond the image
                rows, columns = -(-(-(-height * v // top_v)) // 8), -(-(-(-width * h // top_h)) // 8)
                grid = np.where((np.arange(grid.shape[0]) < rows)[:, None, None] & (np.arange(grid.shape[1]) < columns)[None, :, None], grid, 0)
            units = grid.reshape(grid.shape[0] // v, v, grid.shape[1] // h, h, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
            assert (im.coefs[c] == units).all()
    out = jpeg.describe(spark.createDataFrame(list(enumerate(map(bytearray, files))), "doc_id long, media binary")).orderBy("doc_id").collect()
    assert [(r["width"], r["height"], r["payload_bytes"], r["error"]) for r in out] == [(w, h, None, None) for w, h, _, _ in expected]
    for r, im in zip(out, jpeg.read(files), strict=True):
        pixels = jpeg.thumbnail(im).astype(int)
        cell = [[pixels[y * pixels.shape[0] // 8 : max((y + 1) * pixels.shape[0] // 8, y * pixels.shape[0] // 8 + 1), x * pixels.shape[1] // 9 : max((x + 1) * pixels.shape[1] // 9, x * pixels.shape[1] // 9 + 1)].mean() for x in range(9)] for y in range(8)]
        bits = "".join("1" if row[i] < row[i + 1] else "0" for row in cell for i in range(8))
        assert r["feature"].split(":")[1] == f"{int(bits, 2):016x}"


def test_line_quality_counts(docs, empty, labels, rows):
    out = {r["doc_id"]: r for r in line_quality.label_documents(docs, line_quality.train(docs, labels)).collect()}
    for i, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
        seen, repeated = set(), 0
        for line in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                repeated += line in seen
                seen.add(line)
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), repeated, len(covered))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and not (r["base_failed"] and r["kept"])
    assert line_quality.label_documents(empty, line_quality.train(empty, labels.limit(0))).count() == 0


def test_language(spark, empty):
    rng = random.Random(2)
    parts = {"aa": "ba na ru ki to".split(), "bb": "ste gro pla fri sku".split()}
    made = [(i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(60)), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    train, rest = spark.createDataFrame(made[:60], "doc_id long, text string, lang string"), spark.createDataFrame([*made[60:], (900, None, "aa"), (901, "12 34", "aa")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.predict(rest, language.learn(train)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in made[60:]) and got[900]["lang_pred"] == got[901]["lang_pred"] == "und"
    assert {r["lang_pred"] for r in language.predict(rest, language.learn(empty)).collect()} == {"und"}


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_dup(spark, docs, empty, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.link(docs).collect()}
    assert got == brute_components(rows)
    assert near_dup.link(empty).count() == 0


def test_near_dup_family_and_common_passage(spark):
    """Edited copies of one text that link through each other, and unlike texts that share a passage."""
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    base, passage = fresh(150), fresh(60)
    made = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = fresh(1)[0]
        made.append((i, " ".join(words)))
    made += [(1000 + i, " ".join(fresh(50) + passage + fresh(rng.randrange(4, 60)))) for i in range(80)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.link(docs).collect()} == brute_components(made)


def test_mixing(spark, docs, empty):
    rows = [(i, f"s{i % 4}" if i % 7 else None, (i * 37) % 90) for i in range(600)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.mix(sized, mixing.ranked_weights(sized.select("source").distinct(), (5.0, 2.0, 1.0)), 1.5).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(600)) and all(r["taken"] <= 2 * r["size"] for r in out)
    for s in {r["source"] for r in out}:
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 90
    assert abs(sum({r["source"]: r["target"] for r in out}.values()) - 1.5 * sum(r[2] for r in rows)) < 1
    none = empty.select("doc_id", "source", mixing.word_count(empty["text"]).alias("size"))
    assert mixing.mix(none, mixing.ranked_weights(none.select("source").distinct(), (5.0, 2.0, 1.0)), 1.5).count() == 0


def test_kneser_ney(spark, docs, empty, labels):
    rng = random.Random(9)
    made = [(i, sentence(rng, 80), "en") for i in range(60)] + [(100 + i, "".join(rng.choices("#$%&*QXZ|", k=300)), "en") for i in range(5)] + [(200, None, "en"), (201, "", None)]
    frame = spark.createDataFrame(made, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1, 0) for i in range(40)], LABELS)
    kept = {r["doc_id"]: r["kept"] for r in kneser_ney.classify(frame, marks).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[i] for i in kept if i >= 100)
    assert kneser_ney.classify(empty, labels).count() == 0 and kneser_ney.classify(frame, marks.limit(0)).filter("kept").count() == 65


def test_kneser_ney_rejects_junk_near_clean_text(spark):
    """Text with some strange words lies above the trusted quantile though far below noise; unseen and very short clean texts stay."""
    rng = random.Random(4)
    made = [(i, sentence(rng, 60), "en") for i in range(240)] + [(500 + i, w.capitalize() + ".", "en") for i, w in enumerate(WORDS[2:6])]
    made += [(1000 + i, " ".join("Thsh" if rng.random() < 0.1 else rng.choice(WORDS) for _ in range(60)), "en") for i in range(20)]
    frame = spark.createDataFrame(made, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1, 0) for i in range(160)], LABELS)
    kept = {r["doc_id"]: r["kept"] for r in kneser_ney.classify(frame, marks).collect()}
    assert sum(not kept[i] for i in kept if i >= 1000) >= 18
    assert sum(kept[i] for i in range(160, 240)) >= 76 and all(kept[i] for i in range(500, 504))


def test_kneser_ney_sums_to_one(spark):
    frame = spark.createDataFrame([(1, "abab abba baba ab", "en")], "doc_id long, text string, lang string")
    model = kneser_ney.Model(kneser_ney.count_grams(frame))
    symbols = [ord(c) for c in "ab \x03"]
    context = (ord("b") << 32) | (ord("a") << 16) | ord("b")
    asked = spark.createDataFrame([(context << 16 | s,) for s in [*symbols, 0x7A]], "gram long")
    total = sum(2.718281828459045 ** r["logp"] for r in model.log_probability(asked).collect())
    assert total == pytest.approx(1.0, abs=1e-9)


@pytest.mark.parametrize(
    ("text", "kind", "said"),
    [
        ("mail john dot doe at example dot com now", "email", "john dot doe at example dot com"),
        ("john (at) example.com", "email", "john (at) example.com"),
        ("jοhn@exаmple.com", "email", "jοhn@exаmple.com"),
        ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("ip １９２．１６８．１．１ here", "ip", "１９２．１６８．１．１"),
        ("at 10[.]2[.]3[.]4", "ip", "10[.]2[.]3[.]4"),
    ],
)
def test_pii_disguises(text, kind, said):
    assert [(k, text[s:e]) for k, s, e in pii.disguised(text, pii.plain(text))] == [(kind, said)]


@pytest.mark.parametrize(
    ("text", "kind", "said"),
    [
        ("write john at example.com today", "email", "john at example.com"),
        ("jean arobase exemple.fr", "email", "jean arobase exemple.fr"),
        ("jane dot roe at mail dot ie", "email", "jane dot roe at mail dot ie"),
        ("pedro arroba correo punto mx", "email", "pedro arroba correo punto mx"),
        ("host one nine two dot one six eight dot one dot one. Two more", "ip", "one nine two dot one six eight dot one dot one"),
        ("host 10 dot 0 dot 0 dot one", "ip", "10 dot 0 dot 0 dot one"),
        ("call +49 30 five five 12 34 56 ok", "phone", "+49 30 five five 12 34 56"),
        ("card ４１１１ 1111 1111 1111 five people", "card", "４１１１ 1111 1111 1111"),
    ],
)
def test_pii_at_words_short_spelled_runs_and_endings(text, kind, said):
    assert [(k, text[s:e]) for k, s, e in pii.disguised(text, pii.plain(text))] == [(kind, said)]


def test_pii_leaves_prose_with_at_words_and_digits():
    for text in ["We met at home.It was late", "one two three", "She looked at the dot on page 12", "at noon. Then one of two"]:
        assert pii.disguised(text, pii.plain(text)) == []


def test_pii_plain_matches_the_patterns(spark, docs):
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for text in ["a@b.co x@y.zz@k.ll a@@b.c", ".@-.-", "q@w e@r.t", "@a.b", "1.2.3.4 300.1.1.1 1.2.3", "4111 1111 1111 1111 +1 (555) 010-9999"]:
        assert [x[1:] for x in pii.plain(text) if x[0] == "email"] == [m.span() for m in mail.finditer(text)]
    assert [x[0] for x in pii.plain("1.2.3.4, 4111-1111-1111-1111, +1 (555) 010-9999")] == ["ip", "card", "phone"]
    assert pii.disguised("Meet me at the dot of one two people", []) == []
    assert pii.redact("to a@b.co!", pii.plain("to a@b.co!")) == "to [EMAIL]!"
    assert pii.scan(docs, redacted=True).count() == docs.count()


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='ad'>Buy this now.</div><article><h1>Head of it</h1><p>{}&amp; more\n  text of the page.<p>Second part of it.</article><footer>&copy; site</footer>"
    pages = spark.createDataFrame([(i, "http://x/", page.format("Words here ")) for i in range(30)] + [(98, None, None), (99, "u", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages, html_text.train(pages)).collect()}
    assert got[0] == "Head of it\nWords here & more text of the page.\nSecond part of it." and got[98] == got[99] == ""
    assert html_text.extract(pages.limit(0), html_text.train(pages.limit(0))).count() == 0


FIRST = "The quiet harbour lay under a pale sky while boats came in from the long night at sea, and people waited on the stones."
SECOND = "Nobody had expected the storm to turn north so late in the year, yet it did, and the whole coast felt it for weeks."
LAYOUTS = {
    "links inside": (f"<body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav><article><h1>Storm at sea</h1><p>{FIRST}</p><ul><li><a href=1>First report</a></li><li><a href=2>Second report</a></li></ul><p>{SECOND}</p></article><footer><a href=z>About us</a></footer></body>", ["Storm at sea", FIRST, "First report", "Second report", SECOND]),
    "links last": (f"<body><div class='menu'><a href=x>Home</a></div><main><h1>Storm at sea</h1><p>{FIRST}</p><p>{SECOND}</p><p><a href=1>The full report</a></p><ul><li><a href=2>A map of the coast</a></li></ul></main><aside><ul><li><a href=3>Other story</a></li></ul></aside></body>", ["Storm at sea", FIRST, SECOND, "The full report", "A map of the coast"]),
    "aside inside": (f"<body><article><h1>Storm at sea</h1><p>{FIRST}</p><aside>Read our other story about the northern coast and its people today.</aside><p>{SECOND}</p></article></body>", ["Storm at sea", FIRST, SECOND]),
    "comments inside": (f"<body><article><h1>Storm at sea</h1><p>{FIRST}</p><p>{SECOND}</p><section class='comments'><p>Great story, I was there that night and it was terrible to see.</p><p>Me too!</p></section></article></body>", ["Storm at sea", FIRST, SECOND]),
    "form inside": (f"<body><article><h1>Storm at sea</h1><p>{FIRST}</p><form><label>Your mail</label><button>Send</button></form><p>{SECOND}</p></article></body>", ["Storm at sea", FIRST, SECOND]),
    "content class": (f"<body><div class='menu'><a href=x>Home</a></div><div class='content'><h2>Storm</h2><p>{FIRST}</p><ul><li>Boats lost</li><li>Roads closed</li></ul><p>{SECOND}</p><p>It ended.</p></div><div id=footer>Copyright 2020</div></body>", ["Storm", FIRST, "Boats lost", "Roads closed", SECOND, "It ended."]),
    "main": (f"<body><nav><a href=x>Home</a></nav><main><h1>Storm</h1><p>{FIRST}</p><table><tr><th>Port</th><th>Boats</th></tr><tr><td>North</td><td>12</td></tr></table><pre>x = 1\ny = 2</pre><p>{SECOND}</p></main><footer>All rights reserved</footer></body>", ["Storm", FIRST, "Port", "Boats", "North", "12", "x = 1 y = 2", SECOND]),
    "bare text": (f"<body>{FIRST} {SECOND}</body>", [FIRST + " " + SECOND]),
    "sidebar": (f"<body><div id='sidebar'><h3>Recent</h3><ul><li><a href=1>One story</a></li></ul></div><div class='post'><h1>Storm at sea</h1><p>{FIRST}</p><blockquote>{SECOND}</blockquote></div></body>", ["Storm at sea", FIRST, SECOND]),
    "notices": (f"<body><div class='cookie-notice'>We use cookies to make this site better for all of our readers.</div><div class='ad'>Buy boats now for less.</div><article><header><h1>Storm at sea</h1></header><p>{FIRST}</p><p>{SECOND}</p><footer>Filed under sea</footer></article></body>", ["Storm at sea", FIRST, SECOND]),
    "breaks": (f"<html><body><h1>Storm</h1>{FIRST}<br><br>{SECOND}<p>Short one.</body></html>", ["Storm", FIRST + " " + SECOND, "Short one."]),
    "sections": (f"<body><header><h1>Site name</h1></header><section id='main-content'><h2>Storm</h2><p>{FIRST}</p><h3>After</h3><p>{SECOND}</p><dl><dt>Port</dt><dd>North</dd></dl></section><section class='related-posts'><h3>More</h3><p><a href=x>Another storm far away from here today</a></p></section></body>", ["Storm", FIRST, "After", SECOND, "Port", "North"]),
}


@pytest.fixture(scope="module")
def page_model(spark):
    return html_text.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def test_html_layouts(spark, page_model):
    pages = spark.createDataFrame([(k, "u", p, "clash") for k, (p, _) in LAYOUTS.items()], "page_id string, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages, page_model).collect()}
    assert got == {k: "\n".join(want) for k, (_, want) in LAYOUTS.items()}


@pytest.mark.parametrize("piece", ["<a ", '<p "', '<p ="', "<![CDATA[", "<!", "<b><div>", "<ul><li>", "<table><tr><td>", "&lt", "</b>", "<script>", "<x1>"])
def test_html_hostile_pages_take_linear_time(piece):
    began = time.time()
    html_text.features(html_text.leaf_blocks("<b>" + piece * (1_000_000 // len(piece)) + "</b>" * 1000))
    assert time.time() - began < 15


@pytest.mark.parametrize("piece", ["at-", "-at", "at", "arobase-", "at ", "@-", "[at] ", "_at_", "at]", " .", "x@-."])
def test_pii_gate_takes_linear_time(piece):
    text = piece * (1_000_000 // len(piece))
    began = time.time()
    pii.hinted(text)
    pii.hinted(text + "host.com")
    assert time.time() - began < 2


def test_pii_scans_hostile_texts(spark):
    texts = [p * (200_000 // len(p)) + end for p in ("at-", "-at", "arobase-", "@-") for end in ("", " jane at host.com")]
    out = pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(out) == len(texts) and all(("email" in r["spans"]) >= (r["doc_id"] % 2) for r in out)


@pytest.mark.parametrize("text", ["a_dot_" * 170_000 + "! dot x", "1" * 500_000 + "." + "1" * 500_000, "bob at example dot com, " * 40_000, " " * 1_000_000 + "at", "( " * 500_000, "a at " * 200_000, "one two " * 125_000, "1." * 500_000, "+1(" * 300_000, "a@" * 500_000, "[dot]" * 200_000, "one (.) " * 120_000])
def test_pii_hostile_texts_take_linear_time(text):
    began = time.time()
    pii.disguised(text, pii.plain(text), gate=False)
    assert time.time() - began < 20


def test_pii_gate_reaches_as_far_as_the_transducers():
    rng = random.Random(5)
    bits = ["a", "john", "at", "dot", "[at]", "(dot)", " ", "  ", "\t", "\n", "one", "two", "five", "plus", "1", "192", "10", ".", "-", "_", "@", "example", "com", "de", "_at_", "-dot-", "+", ",", "un", "é", "а", "１", "\u200b", "℡", "“", ":", "(.)", "point"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 30)))
        base = pii.plain(text)
        assert pii.disguised(text, base) == pii.disguised(text, base, gate=False), text
    for gap in ("\t", "\n", " "):
        text = f"john at example{gap}dot{gap}com"
        assert [text[s:e] for _, s, e in pii.disguised(text, [])] == [text]


def brute_pii(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, said):
        digits = [int(c) for c in said if c in "0123456789"]
        odd = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in said.split(".")), "card": 16 <= len(digits) <= 19 and odd % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, text) if good(k, m[0])]


def test_pii_scan_equals_brute_force(spark):
    rng = random.Random(8)
    bits = ["a.b", "@", "x-y", ".", "1", "25", "300", "192.168.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+", " ", "-", "(", "é", "\n", "q@w.e"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(40))), "clash") for i in range(400)] + [(400, None, "x"), (401, "", "x"), (7, "q@w.e 1.2.3.4", "x")]
    for r, (i, text, _) in zip(pii.scan(spark.createDataFrame(rows, "doc_id long, text string, spans string").coalesce(1)).collect(), rows, strict=True):
        want = brute_pii(text or "")
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        counts = tuple(sum(k == kind for k, *_ in want) for kind in ("email", "ip", "card", "phone"))
        assert (r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == (i, *counts, hashlib.sha256(said.encode()).hexdigest())
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(r["spans"].split(","))


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(4)
    lengths = np.array([3, 1, 0, 7, 5])
    x = rng.normal(size=(int(lengths.sum()), 4))
    model = Crf(rng.normal(size=(4, 2)), rng.normal(size=(2, 2)))
    got, at = viterbi(model, x, lengths), 0
    for n in lengths.tolist():
        scores = x[at : at + n] @ model.weights
        best = max(itertools.product((0, 1), repeat=n), key=lambda path: sum(scores[k, y] for k, y in enumerate(path)) + sum(model.moves[a, b] for a, b in itertools.pairwise(path)))
        assert got[at : at + n].tolist() == list(best)
        at += n


def test_language_sizes_equal_plain_zstandard(spark):
    made = [(i, ("wind stone river " * (i % 5 + 1) + str(i)) if i % 2 else ("viento piedra rio " * (i % 4 + 1) + str(i)), "en" if i % 2 else "es") for i in range(40)]
    docs = spark.createDataFrame(made + [(50, "x" * 9000 + " only long", "zz"), (51, None, "en"), (52, "", "qq")], "doc_id long, text string, lang string")
    known = language.learn(docs)
    assert sorted(known) == ["en", "es", "zz"]
    for r in language.predict(docs, known, ("doc_id",)).collect():
        text = {i: t for i, t, _ in docs.collect()}[r["doc_id"]]
        if not text:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        sizes = []
        for lang in sorted(known):
            content = zstandard.ZstdCompressionDict(known[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=language.LEVEL)
            sizes.append((len(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False).compress(text.lower().encode())), lang))
        assert r["lang_pred"] == min(sizes)[1]
    assert language.predict(docs.limit(0), known, ("doc_id",)).count() == 0


def brute_kneser_ney(trusted):
    """Probability of a symbol after three others, by dictionaries."""
    counts = {4: collections.Counter()}
    for t in trusted:
        units = "\x02" * 3 + t + "\x03"
        counts[4].update(units[k : k + 4] for k in range(len(units) - 3))
    for n in (3, 2, 1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in range(5)]
        if not (n[1] and n[2]):
            return [0.75] * 3
        y = n[1] / (n[1] + 2 * n[2])
        raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 0.75]
        return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]

    cut = {n: discounts(c) for n, c in counts.items()}

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / (len(counts[1]) + 1)
        own = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        if not total:
            return p(gram[1:])
        held = sum(cut[n][min(c, 3) - 1] for c in own.values())
        c = own.get(gram, 0)
        return (c - cut[n][min(c, 3) - 1] if c else 0) / total + held / total * p(gram[1:])

    return p


def test_kneser_ney_equals_dictionaries(spark):
    rng = random.Random(12)
    texts = [sentence(rng, 12) for _ in range(8)]
    model = kneser_ney.Model(kneser_ney.count_grams(spark.createDataFrame([(t,) for t in texts], "text string")))
    p = brute_kneser_ney(texts)
    asked = [*texts[:2], "river zz", "", "house light"]
    rows = [(i, "en", i, t) for i, t in enumerate(asked)] + [(9, "en", 9, None)]
    for r in kneser_ney.score(spark.createDataFrame(rows, "doc_id long, lang string, told long, text string"), model).collect():
        units = "\x02" * 3 + (asked[r["doc_id"]] if r["doc_id"] < 9 else "") + "\x03"
        assert r["logp"] == pytest.approx(sum(math.log(p(units[k : k + 4])) for k in range(len(units) - 3)), abs=1e-6)


def test_near_dup_recall_on_known_pairs(spark):
    """Long texts at similarities just above the limit, and pairs just below: all of the first are found, none of the others."""
    rng = random.Random(21)
    made, near, far = [], 0, 0
    for k in range(120):
        words = [f"w{rng.randrange(10**9)}" for _ in range(rng.choice([120, 400, 1500]))]
        other, goal = list(words), 0.76 if k % 2 else 0.72
        shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        own = shingles(words)
        edits = rng.sample(range(len(words)), len(words))
        while edits:
            before = list(other)
            other[edits.pop()] = f"e{rng.randrange(10**9)}"
            both = len(own & shingles(other))
            if both / (2 * len(own) - both) < goal:
                other = before if k % 2 else other
                break
        made += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.link(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(1, 120, 2)) >= 54
    assert got == {i: c for i, (_, c) in brute_components(made).items()}


def test_near_dup_null_and_repeated_ids(spark):
    text, other = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(None, text), (3, text), (3, text), (3, other), (None, other + " more"), (None, "lone words here now and then"), (None, None), (None, "")]
    out = near_dup.link(spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash"))).collect()
    assert len(out) == len(rows)
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"], r["first"]) for r in out if r["n_shingles"] > 0) == sorted(
        [("None", "3", False, False), ("3", "3", True, True), ("3", "3", True, True), ("3", "3", True, True), ("None", "3", False, False), ("None", "None", True, True)]
    )


PIPE = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_stages(spark, tmp_path):
    """Whole run on a small corpus: junk, copies and private data are dealt with, null and repeated ids kept apart, extra columns dropped."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(31)
    clean = [sentence(rng, 80) + (" river at house dot com" if k % 2 else "") for k in range(60)]
    both = lambda a, b: " ".join(clean[a].split()[:40] + clean[b].split()[40:])
    rows = [(i, t, "en", ["s1", "s2", None][i % 3], len(t)) for i, t in enumerate(clean)]
    rows += [(100, clean[3], "en", "s1", 1), (101, clean[4] + " end", "en", "s2", 1), (5, clean[5], "en", "s3", 1), (None, both(10, 12), "en", "s1", 1), (None, both(11, 13), "en", "s2", 1)]
    rows += [(200 + i, "".join(rng.choices("#$%&*QXZ|", k=300)), "en", "s1", 300) for i in range(4)] + [(300, None, "en", "s1", 0), (301, "", None, None, 0), (7, "#$%&*QXZ|" * 40, "en", "s1", 1)]
    spark.createDataFrame([(*r, 1) for r in rows], PIPE + ", k_id int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60) if i != 7], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        seen[name] = docs.collect()
    assert {r["doc_id"] for r in seen["quality classifier"]} == {*range(60), 100, 101, None} and len(seen["quality classifier"]) == 65
    one = sorted(r["text"] for r in seen["near dedup"])
    assert one == sorted([*clean, rows[63][1], rows[64][1]]) and docs.count() == len(seen["mixing"])
    assert sorted(r["text"] for r in seen["pii"]) == sorted(t.replace("river at house dot com", "[EMAIL]") for t in one)
    assert {r["text"] for r in seen["mixing"]} <= {r["text"] for r in seen["pii"]} and max(collections.Counter(r["text"] for r in seen["mixing"]).values()) <= 2
    assert [r["decoded_sha256"] for r in seen["bpe"]] and {r["decoded_sha256"] for r in seen["bpe"]} == {hashlib.sha256(r["text"].encode()).hexdigest() for r in seen["mixing"]}
    assert set(seen["mixing"][0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], PIPE).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_warc(spark):
    rows = [(i, f"https://www.Example{i % 3}.com/p/{i}?b=2&a=1#f", ["same", f"own {i}", "é" * i][i % 3]) for i in range(40)] + [(100, None, None), (101, "::bad::", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.build_index(warc.write(pages))
    got = {r["page_id"]: r for r in warc.fetch(spark, index, pages).collect()}
    for i, _, h in rows:
        same = max(k for k, _, x in rows if (x or "") == (h or ""))
        want = (len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if i == same else "revisit", None if i == same else same)
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == want
    hit = warc.lookup(spark, index, "http://example1.com/P/1?a=1&b=2")
    assert [(c["page"], c["payload"].decode()) for c in hit] == [("1", "own 1")] and warc.lookup(spark, index, "http://none.org/") == []


def test_warc_many_blocks_busy_urls_and_odd_keys(spark, monkeypatch):
    """Blocks of 7 lines: a busy URL over many blocks, keys with spaces, marks and fragments, ids of other types, repeated rows."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "READ_ROWS", 3)
    urls = ["http://a.org/a b", "http://a.org/a!b", "http://a.org/a#b", "http://a.org/a%20b", "http://a.org/a\nb", " http://a.org/~", "http://b.a.org:8080/x?b&a", "http://busy.org/"]
    rows = [(i, urls[i % 8] if i % 3 else urls[7], f"page {i % 50}") for i in range(300)] + [(5, urls[0], "page 5")]
    for kind in ("smallint", "string"):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("page_id", F.col("page_id").cast(kind))
        pages = pages.withColumn("key", F.lit("clash")).withColumn("sha", F.lit(1))
        index = warc.build_index(warc.write(pages))
        out = warc.fetch(spark, index, pages, page_type=kind)
        assert sorted((str(r["page_id"]), r["url"]) for r in out.collect()) == sorted((str(i), u.replace("\n", "%0A")) for i, u, _ in rows)
    for u in urls:
        want = sorted(str(i) for i, x, _ in rows if warc.url_key(x) == warc.url_key(u))
        assert sorted(c["page"] for c in warc.lookup(spark, index, u)) == want and want
    none = pages.limit(0)
    assert warc.fetch(spark, warc.build_index(warc.write(none)), pages).count() == 0
