"""Personal data with offset-preserving deobfuscation.

Plain matches of four kinds are found in the text itself. Then a cascade of small transducers normalises disguises -
homoglyphs and full-width forms, spelled-out digits, ``at`` and ``dot`` words and brackets - and keeps for every
normalised character the span of source characters it came from. The same kinds are looked for in the normalised
text and mapped back; spans that overlap a plain one of any kind are left out, so plain matches always stay. Plain at
and dot words make an address before a known top-level domain only; "us at example.com" then is one, too.
Spans are code points, end exclusive.

Null text counts as empty and has none; an empty table gives no rows. Very long texts are read whole: every pattern is
linear in the text, and what a transducer keeps grows with its edits only. Ties (two readings of one place) go to the
plain match, then to the earlier cascade, then to the earlier kind. Repeated rows give equal rows. Columns of other
names than ``keep`` and the text column are not read, so they can't clash; ``keep`` may not name a result column.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, bound_batches
from .endings import ENDINGS

KINDS = ("email", "ip", "card", "phone")
BLOCK_BYTES = 4 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is read from its start only; from a later digit it could match nothing else.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        if at >= end:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                end = m.end()
                yield start, end
        at = text.find("@", at + 1)


def plain(text: str) -> list[Span]:
    """Base matches, leftmost and non-overlapping by kind; a match that fails its kind's test is dropped."""
    found: list[Span] = [("email", s, e) for s, e in _emails(text)]
    if "." in text:
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


#: Letters of other scripts that look like Latin ones; NFKC covers full-width and other styled forms.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏԛԝАВЕКМНОРСТХІЈЅαοερτυνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ٫۔。．", "aeopcyxijsdhlqwABEKMHOPCTXIJSaoeptuvikABEZHIKMNOPTYX....", strict=True))
HOMOGLYPHS |= {"＠": "@", "﹫": "@", "＋": "+", "﹢": "+", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " "}
#: Characters that show nothing and only break up an identifier.
INVISIBLE = frozenset("​‌‍⁠﻿­")
#: Digits as words.
DIGIT_WORDS = {
    "en": ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"], "de": ["null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"],
    "fr": ["zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"], "es": ["cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"],
}
SPELLED = {w: str(d) for words in DIGIT_WORDS.values() for d, w in enumerate(words)} | {"oh": "0"}
# White space before a mark is read from its start only, and never given back.
_IN = r"(?:(?<!\s)\s*+[\[({<]|[\[({<])\s*+"
_AT = rf"(?:{_IN}(?:at|@|arobase|arroba)\s*+[\])}}>]\s*+|(?<!\s)\s++(?:at|arobase|arroba)\s++|(?:(?<!\s)\s*+@|@)\s*+|_at_|-at-)"
_DOT = rf"(?:{_IN}(?:dot|\.|point|punkt|punto)\s*+[\])}}>]\s*+|(?<!\s)\s++(?:dot|point|punkt|punto)\s++|_dot_|-dot-)"
_MARK = re.compile(rf"(?P<at>{_AT})|{_DOT}", re.I)
_DOT_MARK = re.compile(_DOT, re.I)
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
_DISGUISED_IP = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:{_DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_WORDS = "|".join(sorted(map(re.escape, SPELLED), key=len, reverse=True))
_UNITS = re.compile(rf"(?<!\w)(?:(plus)|{_WORDS}|[0-9]+)(?![^\W_])", re.I)
_UNIT = rf"(?:(?:{_WORDS})(?![^\W_])|[0-9]+(?![^\W_]))"


def _run(gap: str) -> re.Pattern[str]:
    return re.compile(rf"(?<!\w)(?:plus[ -]+(?={_UNIT}))?{_UNIT}(?:(?:{_DOT}|{gap}){_UNIT})+", re.I)


#: Spelled digits beside digits, spelled digits or dot marks. The first ends at a sentence, the second goes on; the test of each kind decides.
_SPELLED_RUNS = (_run(r"(?!\.\s+(?-i:[A-Z]))[ ,.()-]+"), _run("[ ,.()-]+"))
_MARK_WORDS = ("dot", "point", "punkt", "punto", "arobase", "arroba")
#: A run of host letters before a literal dot, from where the run begins.
_DOTTED = re.compile(r"(?<![a-z0-9-])([a-z0-9-]*+)\.(?=[a-z0-9-])")
_AT_IN_RUN = re.compile("(?:at|arobase|arroba)-")
_AT_WORDS = ("at", "arobase", "arroba", "@")
_APART = "".join(c if c.isalnum() else " " for c in map(chr, range(128)))
_SAID = frozenset(SPELLED) | {"plus"}


@lru_cache(256)
def _pair(words: frozenset[str]) -> re.Pattern[str]:
    """Two units side by side, at least one of them among ``words``; without such a pair, only dot marks make runs."""
    any_of = f"(?:{'|'.join(sorted(map(re.escape, words), key=len, reverse=True))})(?![^\\W_])"
    return re.compile(rf"{any_of}[ ,.()-]+(?:[0-9]|{any_of})|[0-9][ ,.()-]+{any_of}", re.I)


def _at_host(low: str) -> bool:
    """Whether an at mark may stand before a host with a literal dot, in small letters. Each run of host letters is looked at once."""
    for run in _DOTTED.finditer(low):
        start = at = run.start()
        if _AT_IN_RUN.search(run[1]) or (run[1][:1] == "-" and low[start - 1 : start] == "@"):
            return True
        while at and (low[at - 1] in "])}>_" or low[at - 1].isspace()):
            at -= 1
        if at < start and low.endswith(_AT_WORDS, max(0, at - 7), at):
            return True
        if at == start > 1 and low[at - 1] == "@" and (low[at - 2] in "[({<" or low[at - 2].isspace()):
            return True
    return False


def hinted(text: str) -> bool:
    """Whether any transducer could change anything: a glyph to replace, a digit word, a dot mark, or an at mark before a host."""
    low, apart = text.lower(), _APART
    if not text.isascii():
        far = [c for c in set(text) if c > "\x7f"]
        if any(_look_alike(c) is not None for c in far):
            return True
        if any(not c.isalnum() for c in far):
            apart = {k: _APART[k] for k in range(128)} | {ord(c): " " for c in far if not c.isalnum()}
    said = _SAID.intersection(low.translate(apart).split())
    if said and _pair(said).search(text):
        return True
    bracketed = any(c in text for c in "[({<")
    if (bracketed or any(w in low for w in _MARK_WORDS)) and _DOT_MARK.search(text):
        return True
    return _at_host(low)


class Tape:
    """A text and its edits, each with its place here and in the source; elsewhere places only shift."""

    def __init__(self, text: str, edits: list[tuple[int, int, int, int]] | None = None) -> None:
        self.text, self.edits = text, edits or []
        self.places = [x[0] for x in self.edits]

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a range of characters."""
        return self._of(start)[0], self._of(end - 1)[1]

    def _of(self, at: int) -> tuple[int, int]:
        k = bisect_right(self.places, at) - 1
        if k < 0:
            return at, at + 1
        _, end, s, e = self.edits[k]
        return (s, e) if at < end else (at + e - end, at + e - end + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replace ranges, in order and not overlapping; each new character stands for its whole range."""
        if not edits:
            return self
        text: list[str] = []
        out: list[tuple[int, int, int, int]] = []
        at, k, shift = 0, 0, 0
        old = self.edits
        for s, e, new in edits:
            text += [self.text[at:s], new]
            at = e
            while k < len(old) and old[k][1] <= s:
                out.append((old[k][0] + shift, old[k][1] + shift, *old[k][2:]))
                k += 1
            if k < len(old) and old[k][0] < s:  # an older edit that this one cuts: its first part stays
                out.append((old[k][0] + shift, s + shift, *old[k][2:]))
            start, end = self.source(s, e)
            out.append((s + shift, s + shift + len(new), start, end))
            shift += len(new) - (e - s)
            while k < len(old) and old[k][1] <= e:
                k += 1
            if k < len(old) and old[k][0] < e:  # and its last part
                out.append((e + shift, old[k][1] + shift, *old[k][2:]))
                k += 1
        out += [(a + shift, b + shift, c, d) for a, b, c, d in old[k:]]
        return Tape("".join([*text, self.text[at:]]), out)


@cache
def _look_alike(c: str) -> str | None:
    """What a character reads as, or None to keep it."""
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if c > "˿":
        if (d := unicodedata.decimal(c, None)) is not None:
            return str(d)
        plain_form = unicodedata.normalize("NFKC", c)
        if plain_form != c and plain_form.isascii():
            return plain_form
    return None


def glyphs(tape: Tape) -> Tape:
    if tape.text.isascii():
        return tape
    new = {c: x for c in set(tape.text) if c > "\x7f" and (x := _look_alike(c)) is not None}
    longer = "".join(c for c, x in new.items() if len(x) != 1)
    if longer:
        tape = tape.rewrite([(m.start(), m.end(), new[m[0]]) for m in re.finditer(f"[{re.escape(longer)}]", tape.text)])
    return Tape(tape.text.translate({ord(c): x for c, x in new.items() if len(x) == 1}), tape.edits)


def spelled_digits(tape: Tape, runs: re.Pattern[str] = _SPELLED_RUNS[0]) -> Tape:
    edits = []
    for run in runs.finditer(tape.text):
        units = list(_UNITS.finditer(tape.text, run.start(), run.end()))
        gaps = [(a.end(), b.start(), tape.text[a.end() : b.start()]) for a, b in zip(units, units[1:], strict=False)]
        dotted = sum(g.strip() == "." for _, _, g in gaps) == 3
        octets = dotted or sum(_DOT_MARK.fullmatch(g) is not None for _, _, g in gaps) == 3
        for k, m in enumerate(units):
            spelled = not m[0].isdecimal()
            if spelled:
                edits.append((m.start(), m.end(), "+" if m[1] else SPELLED[m[0].lower()]))
            if k < len(gaps):
                s, e, g = gaps[k]
                both = (spelled and not units[k + 1][0].isdecimal()) or (octets and spelled != (not units[k + 1][0].isdecimal()))
                if dotted and g.strip() == ".":
                    edits.append((s, e, "."))
                elif s < e and both and not g.strip(" ,.()-"):
                    edits.append((s, e, ""))
    return tape.rewrite(edits)


def _said(labels: list[str], at: str, dots: bool) -> bool:
    """Whether words joined by a plain at word are an address: the host has a known ending that isn't a sentence's first word."""
    if any(c in at for c in "[({<@"):
        return True
    before, last = labels[-2:]
    return last.lower() in ENDINGS and (dots or not (last.istitle() and before[:1].islower()))


def _tail(text: str, low: int, high: int) -> int:
    """Where the characters of a local part that end at ``high`` begin."""
    at = high
    while at > low and text[at - 1] in _LOCAL:
        at -= 1
    while at < high and text[at] == ".":
        at += 1
    return at


def at_and_dot(tape: Tape) -> Tape:
    """At and dot marks of addresses: names and dot marks to the left of an at mark, host labels with at least one dot to its right."""
    text = tape.text
    marks = [(m.start(), m.end(), m["at"] is not None) for m in _MARK.finditer(text)]
    edits: list[tuple[int, int, str]] = []
    done = 0
    for k, (s, e, is_at) in enumerate(marks):
        if not is_at or s < done:
            continue
        first, low = k, max(done, marks[k - 1][1] if k else 0)
        start = _tail(text, low, s)
        if start == s or text[s - 1] == ".":
            continue
        while start == low and first and not marks[first - 1][2] and marks[first - 1][0] >= done:
            # The whole stretch back to a dot mark is a name, so what stands before the mark belongs to it.
            before = max(done, marks[first - 2][1] if first > 1 else 0)
            high = marks[first - 1][0]
            further = _tail(text, before, high)
            if further == high or text[high - 1] == ".":
                break
            first, low, start = first - 1, before, further
        last, end = k, 0
        labels: list[str] = []
        while True:
            stop = marks[last + 1][0] if last + 1 < len(marks) else len(text)
            m = _HOST.match(text, marks[last][1], stop)
            if not m:
                break
            end = m.end()
            labels += m[0].split(".")
            if end < stop or last + 1 == len(marks) or marks[last + 1][2]:
                break
            last += 1
        if end <= marks[last][1]:
            last -= 1
        if len(labels) < 2:
            continue
        words = marks[first:k] + marks[k + 1 : last + 1]
        if _said(labels, text[s:e], bool(words)):
            edits += [(a, b, "@" if at else ".") for a, b, at in marks[first : last + 1]]
        done = end
    tape = tape.rewrite(edits)
    edits = []
    for m in _DISGUISED_IP.finditer(tape.text):
        edits += [(x.start(), x.end(), ".") for x in _DOT_MARK.finditer(tape.text, m.start(), m.end())]
    return tape.rewrite(edits)


#: Cascades, the widest reading first: what one joins wrongly, for example digits and a word after them, the next ones find.
CASCADES = (
    (glyphs, spelled_digits, at_and_dot),
    (glyphs, lambda tape: spelled_digits(tape, _SPELLED_RUNS[1]), at_and_dot),
    (glyphs, at_and_dot),
)


def disguised(text: str, base: list[Span], gate: bool = True) -> list[Span]:
    """Spans that only the normalised text shows. ``gate=False`` runs the cascades on texts without any hint, too."""
    if gate and not hinted(text):
        return []
    covered = bytearray(len(text))
    for _, s, e in base:
        covered[s:e] = b"\1" * (e - s)
    out, seen = [], {text}
    for cascade in CASCADES:
        tape = Tape(text)
        for step in cascade:
            tape = step(tape)
        if tape.text in seen:
            continue
        seen.add(tape.text)
        for kind, s, e in plain(tape.text):
            start, end = tape.source(s, e)
            if (end - start != e - s or text[start:end] != tape.text[s:e]) and covered.find(1, start, end) < 0:
                out.append((kind, start, end))
                covered[start:end] = b"\1" * (end - start)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or the union of those that overlap, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", redacted: bool = False) -> DataFrame:
    """``keep``, counts of plain matches, n_added, base_sha256, spans, and the redacted text if asked for (null stays null)."""
    bound_batches(docs.sparkSession)
    frame = docs.select(*keep, docs[text_col].cast("string").alias("__text"))
    counts = [f"n_{k}" for k in KINDS]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema if f.name != "__text") + ", ".join(f"{c} long" for c in [*counts, "n_added"]) + ", base_sha256 string, spans string" + ", redacted string" * redacted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text", BLOCK_BYTES):
            rows: dict[str, list] = {c: [] for c in [*counts, "n_added", "base_sha256", "spans", "redacted"]}
            for text in block.column("__text").to_pylist():
                base = plain(text or "")
                added = disguised(text or "", base)
                for k in KINDS:
                    rows[f"n_{k}"].append(sum(x[0] == k for x in base))
                rows["n_added"].append(len(added))
                rows["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                rows["spans"].append(joined(base + added))
                if redacted:
                    rows["redacted"].append(text if text is None else redact(text, base + added))
            made = {c: pa.array(v, pa.int64() if c[:2] == "n_" else pa.string()) for c, v in rows.items() if c != "redacted" or redacted}
            yield from pa.table({**{c: block.column(c) for c in keep}, **made}).combine_chunks().to_batches()

    return frame.mapInArrow(run, schema)
