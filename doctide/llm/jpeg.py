"""Baseline JPEG as a media column: a lossless carrier of bytes, a scan decoder and DC-only thumbnails.

``carry`` stores a payload as the quantised coefficients of 8x8 luminance blocks, 64 bytes a block in zigzag order,
each byte less ``SHIFT``. The quantisation steps are 1 and the entropy coding loses nothing, so the stored bytes
give the payload back. ``read`` is the general reader: it parses the markers of any baseline JPEG (several
components in one scan or in several, sampling factors, restart intervals) and Huffman-decodes the scans of many images in
lockstep, one symbol a step for every restart interval. A thumbnail takes the DC coefficient of each luminance block as a pixel.

Repeated rows give equal media and an empty table none. There are no ties. A very long text becomes one tall image and
is held whole by its task, with about 20 bytes of arrays a byte of text. Columns other than the id and the text, or the
media, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, bound_batches, utf8

BLOCK_BYTES = 2 << 20
SHIFT = 96
#: Blocks of a restart interval in stored payloads, and image widths in blocks at most.
RESTART, MAX_BLOCKS = 4, 8191
#: Fixed values of the format: where the zigzag order's coefficients stand in a block.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])


class Table:
    """A Huffman table: codes for writing; for reading, the symbol and length behind every 16-bit prefix."""

    def __init__(self, counts: list[int], symbols: list[int]) -> None:
        self.counts, self.symbols = list(counts), list(symbols)
        self.code, self.length = np.zeros(256, np.int64), np.zeros(256, np.int64)
        found = np.zeros(1 << 16, np.int64)  # length << 8 | symbol; 0: no code
        code, k = 0, 0
        for bits, n in enumerate(counts, 1):
            for _ in range(n):
                s = symbols[k]
                self.code[s], self.length[s] = code, bits
                found[code << 16 - bits : (code + 1) << 16 - bits] = bits << 8 | s
                code, k = code + 1, k + 1
            code <<= 1
        self.value, self.move = self._moves(found)

    @staticmethod
    def _moves(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Behind every prefix, the value where its bits are in the prefix too; and in one number the bits to pass (6),

        whether the value's bits lie beyond (1), coefficients to move on at bit 8 (7), code length at 16 (5), size at 21.
        """
        length, symbol = found >> 8, found & 0xFF
        run, size = symbol >> 4, symbol & 15
        near = length + size <= 16
        value = (np.arange(1 << 16) >> np.maximum(16 - length - size, 0)) & ((1 << size) - 1)
        value = np.where((size > 0) & near, np.where(value >> np.maximum(size - 1, 0) == 0, value - (1 << size) + 1, value), 0)
        skip = np.where(symbol == 0, 64, run + 1)
        move = (length + size) | np.where(near, 0, 64) | skip << 8 | length << 16 | size << 21
        return value, np.where(found > 0, move, 0)

    def segment(self, kind: int) -> bytes:
        body = bytes([kind, *self.counts, *self.symbols])
        return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


def _table(by_length: dict[int, list[int]]) -> Table:
    return Table([len(by_length.get(n, [])) for n in range(1, 17)], [s for n in range(1, 17) for s in by_length.get(n, [])])


#: Sizes of values come first, as letters lie 1 to 26 above SHIFT; every other run and size follows with 14 or 16 bits.
_SHORT = {2: [0x05, 0x04], 3: [0x03, 0x07], 4: [0x02, 0x00], 5: [0x01], 6: [0x08, 0x06], 8: [0x14, 0x13], 9: [0x12, 0x17], 10: [0x11, 0xF0]}
AC = _table(_SHORT | {14: (rest := [r << 4 | s for r in range(16) for s in range(1, 11) if not any(r << 4 | s in v for v in _SHORT.values())])[:40], 16: rest[40:]})
DC = _table({3: [0, 4, 5, 6, 7], 4: [3, 2, 8], 5: [1], 6: [9], 7: [10], 8: [11]})


#: By value + 256: bits of its size, the value's bits, and code with value bits for a coefficient that follows no zero.
_VALUES = np.arange(-256, 257)
_SIZE = np.array([int(abs(v)).bit_length() for v in _VALUES.tolist()])
_BITS = np.where(_VALUES < 0, _VALUES + (1 << _SIZE) - 1, _VALUES)
_NEXT_CODE, _NEXT_LENGTH = (AC.code[_SIZE] << _SIZE | _BITS).astype(np.uint32), (AC.length[_SIZE] + _SIZE).astype(np.uint8)
_DC_CODE, _DC_LENGTH = (DC.code[_SIZE] << _SIZE | _BITS).astype(np.uint32), (DC.length[_SIZE] + _SIZE).astype(np.uint8)


def carry(payloads: list[bytes]) -> list[bytes]:
    """A baseline grey-scale JPEG for each payload; its length must be a positive multiple of 64."""
    n_blocks = np.array([len(p) // 64 for p in payloads], np.int64)
    wide = np.maximum(np.ceil(np.sqrt(n_blocks)).astype(np.int64), -(-n_blocks // MAX_BLOCKS))
    high = -(-n_blocks // wide)
    cells = wide * high
    coefs = np.zeros((int(cells.sum()), 64), np.int16)
    first = np.cumsum(cells) - cells
    place = np.repeat(first - (np.cumsum(n_blocks) - n_blocks), n_blocks) + np.arange(int(n_blocks.sum()))
    coefs[place] = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 64).astype(np.int16) - SHIFT
    image = np.repeat(np.arange(len(payloads)), cells)
    within = np.arange(len(coefs)) - np.repeat(first, cells)
    # 65 slots a block in scan order: DC, 63 AC, end of block; a slot without bits has length 0.
    fresh = within % RESTART == 0
    code, length = np.zeros((len(coefs), 65), np.uint32), np.zeros((len(coefs), 65), np.uint8)
    dc = coefs[:, 0] - np.where(fresh, 0, np.r_[0, coefs[:-1, 0]]) + 256
    code[:, 0], length[:, 0] = _DC_CODE[dc], _DC_LENGTH[dc]
    shifted = coefs[:, 1:] + 256
    code[:, 1:64], length[:, 1:64] = _NEXT_CODE[shifted], _NEXT_LENGTH[shifted]
    zero = coefs[:, 1:] == 0
    for row in np.flatnonzero(zero.any(1)).tolist() if zero.any() else ():
        _zeros(coefs[row], code[row], length[row])
    code, length = code.ravel(), length.ravel().astype(np.int64)
    lane_starts = np.flatnonzero(fresh)
    cuts = lane_starts * 65
    offset = np.cumsum(length) - length
    bits = np.diff(np.append(offset[cuts], offset[-1] + length[-1]))
    whole = -(-bits // 8)
    lane_image = image[lane_starts]
    final = np.r_[lane_image[1:] != lane_image[:-1], True]
    start_byte = np.cumsum(whole) - whole
    offset += np.repeat(start_byte * 8 - offset[cuts], np.diff(np.append(cuts, len(code))))
    pad = whole * 8 - bits
    packed = _pack(offset, code, length, int(whole.sum()))
    packed[start_byte + whole - 1] |= ((1 << pad) - 1).astype(np.uint8)
    # Byte stuffing after FF, then markers between the lanes of an image.
    stuffed = packed == 0xFF
    shift = np.cumsum(stuffed) - stuffed
    lane_of_byte = np.repeat(np.arange(len(whole)), whole)
    marker_before = np.cumsum(~final) - ~final
    target = np.arange(len(packed)) + shift + 2 * marker_before[lane_of_byte]
    total = len(packed) + int(stuffed.sum()) + 2 * int((~final).sum())
    out = np.zeros(total, np.uint8)
    out[target] = packed
    lane_end = start_byte + whole - 1
    end = target[lane_end] + stuffed[lane_end] + 1
    inner = np.flatnonzero(~final)
    out[end[inner]] = 0xFF
    out[end[inner] + 1] = 0xD0 + (within[lane_starts[inner]] // RESTART) % 8
    scans, scan_ends = out.tobytes(), end[final].tolist()
    made, at = [], 0
    for k, stop in enumerate(scan_ends):
        made.append(_header(int(wide[k]), int(high[k]), len(payloads[k])) + scans[at:stop] + b"\xff\xd9")
        at = stop
    return made


def _zeros(coefs: np.ndarray, code: np.ndarray, length: np.ndarray) -> None:
    """Slots of a block with zero coefficients: runs, long runs in slots of their own zeros, and the end of the block."""
    before = 0
    for c in np.flatnonzero(coefs[1:]).tolist():
        c += 1
        length[before + 1 : c] = 0
        run = c - before - 1
        for j in range(run // 16):
            code[before + 16 * (j + 1)], length[before + 16 * (j + 1)] = AC.code[0xF0], AC.length[0xF0]
        if run:
            size, bits = int(_SIZE[coefs[c] + 256]), int(_BITS[coefs[c] + 256])
            symbol = (run % 16) << 4 | size
            code[c], length[c] = AC.code[symbol] << size | bits, AC.length[symbol] + size
        before = c
    if before < 63:
        length[before + 1 : 64] = 0
        code[64], length[64] = AC.code[0], AC.length[0]


def _pack(offset: np.ndarray, code: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
    """Codes of at most 31 bits laid out from their bit offsets on, which rise; no two overlap."""
    word = offset >> 5
    spread = code.astype(np.uint64) << (64 - (offset & 31) - length).view(np.uint64)
    spread[length == 0] = 0
    words = np.zeros((size * 8 >> 5) + 3, np.uint64)
    cuts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words[word[cuts]] = np.add.reduceat(spread >> np.uint64(32), cuts)
    words[word[cuts] + 1] += np.add.reduceat(spread & np.uint64(0xFFFFFFFF), cuts)
    return words.astype(">u4").view(np.uint8)[:size]


def _header(wide: int, high: int, size: int) -> bytes:
    frame = struct.pack(">BHHB", 8, high * 8, wide * 8, 1) + bytes([1, 0x11, 0])
    return b"".join([
        b"\xff\xd8\xff\xfe", struct.pack(">H", 18), b"bytes", struct.pack(">QHx", size, SHIFT)[:11], b"\xff\xdb", struct.pack(">H", 67), b"\0", b"\1" * 64,
        b"\xff\xc0", struct.pack(">H", 2 + len(frame)), frame, DC.segment(0x00), AC.segment(0x10), b"\xff\xdd", struct.pack(">HH", 4, RESTART), b"\xff\xda", struct.pack(">H", 8), bytes([1, 1, 0x00, 0, 63, 0]),
    ])


@dataclass
class Scan:
    """Components of a scan (by their place) with their DC and AC tables, and its restart intervals."""

    comps: list[tuple[int, bytes, bytes]]
    restart: int
    lanes: list[bytes]


@dataclass
class Image:
    """What the markers say: size, components (id, sampling, quantisation), tables, and the entropy-coded scans."""

    width: int = 0
    height: int = 0
    comps: list[dict] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)
    restart: int = 0
    payload: tuple[int, int] | None = None
    scans: list[Scan] = field(default_factory=list)
    coefs: list[np.ndarray] = field(default_factory=list)
    error: str = ""


def parse(data: bytes) -> Image:
    """Markers of one file; ``error`` tells what is not baseline or broken."""
    im = Image()
    if data[:2] != b"\xff\xd8":
        im.error = "no SOI"
        return im
    at = 2
    try:
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            if data[at] != 0xFF:
                raise ValueError("marker expected")
            kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            if len(body) != size - 2:
                raise ValueError("cut off")
            at += 2 + size
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    im.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif kind == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    im.tables[body[0]] = body[1:n]
                    body = body[n:]
            elif kind in (0xC0, 0xC1):
                depth, im.height, im.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8:
                    raise ValueError("not 8 bits a sample")
                im.comps = [{"id": body[6 + 3 * k], "h": body[7 + 3 * k] >> 4, "v": body[7 + 3 * k] & 15, "q": body[8 + 3 * k]} for k in range(n)]
            elif 0xC2 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not baseline")
            elif kind == 0xDD:
                im.restart = struct.unpack(">H", body)[0]
            elif kind == 0xFE and body[:5] == b"bytes" and len(body) == 16:
                im.payload = struct.unpack_from(">QH", body, 5)
            elif kind == 0xDA:
                named = [(next(i for i, c in enumerate(im.comps) if c["id"] == body[1 + 2 * k]), body[2 + 2 * k]) for k in range(body[0])]
                seen = {c for scan in im.scans for c, _, _ in scan.comps}
                if not named or len({i for i, _ in named} - seen) < len(named):
                    raise ValueError("scans that repeat a component")
                lanes, at = _lanes(data, at)
                im.scans.append(Scan([(i, im.tables[t >> 4], im.tables[0x10 | t & 15]) for i, t in named], im.restart, lanes))
                if len(seen) + len(named) == len(im.comps):
                    return im
    except KeyError:
        im.error = "no table"
        return im
    except (ValueError, IndexError, struct.error, StopIteration) as e:
        im.error = str(e) or type(e).__name__
        return im


def _lanes(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The scan's restart intervals without stuffing, and where it ends."""
    raw = np.frombuffer(data, np.uint8)[at:]
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    ends = ff[(after != 0) & (after != 0xFF) & ((after < 0xD0) | (after > 0xD7))]
    stop = int(ends[0]) if len(ends) else len(raw)
    cuts = ff[(after >= 0xD0) & (after <= 0xD7) & (ff < stop)].tolist()
    body = raw[:stop].tobytes()
    return [body[s:e].replace(b"\xff\x00", b"\xff") for s, e in zip([0, *(c + 2 for c in cuts)], [*cuts, stop], strict=True)], at + stop


@lru_cache(64)
def _read_table(raw: bytes) -> Table:
    return Table(list(raw[:16]), list(raw[16:]))


def read(files: list[bytes]) -> list[Image]:
    """Parsed images with ``coefs``: for each component an array (blocks, 64) of quantised values in zigzag order, MCU by MCU."""
    images = [parse(f) for f in files]
    looks: dict[bytes, int] = {}
    stack: list[Table] = []

    def table(raw: bytes) -> int:
        if raw not in looks:
            looks[raw] = len(stack)
            stack.append(_read_table(raw))
        return looks[raw]

    lanes, lane_blocks, lane_scan, patterns = [], [], [], {}
    for k, im in enumerate(images):
        for at, scan in enumerate(im.scans if not im.error else []):
            alone = len(scan.comps) == 1
            patterns[k, at] = tuple((c, table(dc), table(ac)) for c, dc, ac in scan.comps for _ in range(1 if alone else im.comps[c]["h"] * im.comps[c]["v"]))
            down, across = _grid(im, scan.comps[0][0]) if alone else _units(im)
            left = down * across
            for lane in scan.lanes:
                n = min(scan.restart or left, left)
                if n <= 0:
                    break
                left -= n
                lanes.append(lane)
                lane_blocks.append(n * len(patterns[k, at]))
                lane_scan.append((k, at))
            if left:
                im.error = "cut off"
    if not lanes:
        return images
    coefs, good = _decode(lanes, np.array(lane_blocks), [patterns[x] for x in lane_scan], (np.concatenate([t.value for t in stack]), np.concatenate([t.move for t in stack])))
    bounds = np.concatenate([[0], np.cumsum(lane_blocks)])
    by_scan: dict[tuple[int, int], list[int]] = {}
    for n, x in enumerate(lane_scan):
        by_scan.setdefault(x, []).append(n)
    for k, im in enumerate(images):
        im.coefs = [np.zeros((0, 64), np.int16)] * len(im.comps) if im.scans and not im.error else []
    for (k, at), own in by_scan.items():
        im, scan = images[k], images[k].scans[at]
        if not good[own].all():
            im.error, im.coefs = im.error or "bad code", []
        if im.error:
            continue
        mine = coefs[bounds[own[0]] : bounds[own[-1] + 1]]
        if len(scan.comps) == 1:
            im.coefs[scan.comps[0][0]] = _by_unit(im, scan.comps[0][0], mine)
            continue
        which = np.array([c for c, _, _ in patterns[k, at]])
        slots = np.arange(len(mine)) % len(which)
        for c, _, _ in scan.comps:
            im.coefs[c] = mine[which[slots] == c]
    return images


def _units(im: Image) -> tuple[int, int]:
    """Rows and columns of the units that scans of several components are coded in."""
    h, v = (max(c["h"] for c in im.comps), max(c["v"] for c in im.comps)) if len(im.comps) > 1 else (1, 1)
    return -(-im.height // (8 * v)), -(-im.width // (8 * h))


def _grid(im: Image, comp: int) -> tuple[int, int]:
    """Rows and columns of the blocks of a component in a scan of its own, which goes line by line and not beyond the image."""
    if len(im.comps) == 1:
        return _units(im)
    c, h, v = im.comps[comp], max(c["h"] for c in im.comps), max(c["v"] for c in im.comps)
    return -(-(-(-im.height * c["v"] // v)) // 8), -(-(-(-im.width * c["h"] // h)) // 8)


def _by_unit(im: Image, comp: int, blocks_: np.ndarray) -> np.ndarray:
    """Blocks of a scan of one component in the order that units have, zeros where the scan has none."""
    if len(im.comps) == 1:
        return blocks_
    (down, across), c = _units(im), im.comps[comp]
    rows, columns = _grid(im, comp)
    whole = np.zeros((down * c["v"], across * c["h"], 64), blocks_.dtype)
    whole[:rows, :columns] = blocks_.reshape(rows, columns, 64)
    return whole.reshape(down, c["v"], across, c["h"], 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)


def _decode(lanes: list[bytes], n_blocks: np.ndarray, patterns: list[tuple], look: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All lanes in lockstep, a symbol a step; lanes that are done leave."""
    raw = np.frombuffer(b"".join(x + b"\xff" * 8 for x in lanes) + b"\xff" * 8, np.uint8)
    sizes = np.array([len(x) + 8 for x in lanes], np.int64)
    pos = (np.cumsum(sizes) - sizes) * 8
    limit = pos + (sizes - 8) * 8
    wide = raw.astype(np.uint64)
    window = wide[:-7].copy()
    for i in range(1, 6):  # 48 bits from every byte on
        window = window << np.uint64(8) | wide[i : len(wide) - 7 + i]
    kinds = {p: k for k, p in enumerate(dict.fromkeys(patterns))}
    longest = max(map(len, kinds))
    comp, dc_at, ac_at = (np.zeros((len(kinds), longest), np.int64) for _ in range(3))
    period = np.array([len(p) for p in kinds], np.int64)
    for p, k in kinds.items():
        for j, (c, d, a) in enumerate(p):
            comp[k, j], dc_at[k, j], ac_at[k, j] = c, d << 16, a << 16
    kind = np.array([kinds[p] for p in patterns], np.int64)
    simple = len(kinds) == 1 and longest == 1
    n_cells = int(n_blocks.sum())
    out = np.zeros(n_cells * 64, np.int16)
    good = np.ones(len(lanes), bool)
    lane = np.arange(len(lanes))
    block, last = np.cumsum(n_blocks) - n_blocks, np.cumsum(n_blocks)
    first_block = block.copy()
    k = np.zeros(len(lanes), np.int64)
    dc_before = np.zeros((len(lanes), int(comp.max()) + 1), np.int64)
    value_of, moves = look
    while len(lane):
        bits = window[pos >> 3] << ((pos & 7) + 16).view(np.uint64)  # 41 bits or more at the top
        dc = k == 0
        some_dc = dc.any()
        if simple:
            base = np.where(dc, dc_at[0, 0], ac_at[0, 0]) if some_dc else ac_at[0, 0]
        else:
            slot = (block - first_block) % period[kind]
            base = np.where(dc, dc_at[kind, slot], ac_at[kind, slot])
        at = base + (bits >> np.uint64(48)).view(np.int64)
        value, move = value_of[at], moves[at]
        skip, pos = move >> 8, pos + (move & 63)
        if (far := move & 64).any():  # the value's bits lie beyond the prefix
            far = np.flatnonzero(far)
            length, size = (move[far] >> 16) & 31, (move[far] >> 21) & 15
            skip = skip & 127
            v = ((bits[far] << length.view(np.uint64)) >> (64 - size).view(np.uint64)).view(np.int64)
            value[far] = np.where(v >> size - 1 == 0, v - (1 << size) + 1, v)
        else:
            skip = skip & 127
        if some_dc:
            skip[dc] = 1
            i = np.flatnonzero(dc)
            c = 0 if simple else comp[kind[i], slot[i]]
            value[i] = dc_before[lane[i], c] = dc_before[lane[i], c] + value[i]
        k += skip
        bad = (move == 0) | (pos > limit) | ((k > 64) & (skip < 64))
        out[(block << 6) + np.minimum(k - 1, 63)] = value  # the end of a block writes the zero that stands there
        over = k > 63
        if over.any():
            block += over
            k[over] = 0
        done = bad | (block >= last)
        if done.any():
            good[lane[bad]] = False
            keep = ~done
            lane, pos, block, k, last, first_block, kind, limit = (x[keep] for x in (lane, pos, block, k, last, first_block, kind, limit))
    return out.reshape(-1, 64), good


def thumbnail(im: Image) -> np.ndarray:
    """DC-only luminance, a pixel for each 8x8 block of the first component."""
    c = im.comps[0]
    dc = im.coefs[0][:, 0].astype(np.int64) * int(im.quant[c["q"]][0])
    pixels = np.clip((dc + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    h, v = (c["h"], c["v"]) if len(im.comps) > 1 else (1, 1)
    top_h, top_v = (max(x["h"] for x in im.comps), max(x["v"] for x in im.comps)) if len(im.comps) > 1 else (1, 1)
    across, down = -(-im.width // (8 * top_h)), -(-im.height // (8 * top_v))
    grid = pixels.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    return grid[: -(-im.height * v // (8 * top_v)), : -(-im.width * h // (8 * top_h))]


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits: whether each of 8x8 cell means is below its right neighbour's; 16 hex digits."""
    down, across = pixels.shape
    r, c = np.arange(9) * down // 8, np.arange(10) * across // 9
    cell = np.add.reduceat(np.add.reduceat(pixels, r[:-1], 0, dtype=np.int64), c[:-1], 1)
    cell = cell / (np.maximum(np.diff(r), 1)[:, None] * np.maximum(np.diff(c), 1))
    return np.packbits(cell[:, :-1] < cell[:, 1:]).tobytes().hex()


def padded(text: bytes) -> bytes:
    return text + b"\0" * (64 - len(text) if len(text) < 64 else -len(text) % 64)


def restored(im: Image) -> bytes:
    """The payload of a stored image."""
    assert im.payload is not None and not im.error, im.error or "no payload"
    size, shift = im.payload
    return (im.coefs[0].ravel()[:size].astype(np.int32) + shift).astype(np.uint8).tobytes()


def store_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and ``media``: each whole text (null: empty) as a JPEG that carries its padded bytes."""
    bound_batches(docs.sparkSession)
    frame = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            texts = utf8(block, "text")
            media = carry([padded(t) for t in texts])
            yield from pa.table({"id": block.column("id"), "n_bytes": pa.array(map(len, texts), pa.int64()), "media": pa.array(media, pa.binary())}).combine_chunks().to_batches()

    return frame.mapInArrow(run, f"id {frame.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def describe(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Width, height, thumbnail hash, error, and what the stored bytes read back to, for any column of JPEG files.

    Null or broken media give nulls and an ``error``; files that carry no payload give null payload columns.
    """
    bound_batches(media.sparkSession)
    keep = [c for c in ("n_bytes",) if c in media.columns]
    frame = media.select(media[id_col].alias("id"), *keep, media[media_col].alias("media"))
    schema = f"id {frame.schema['id'].dataType.simpleString()}, " + "".join(f"{c} long, " for c in keep) + "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "media", BLOCK_BYTES):
            files = [x or b"" for x in block.column("media").to_pylist()]
            rows: list[tuple] = []
            for im, data in zip(read(files), files, strict=True):
                stored = (len(data), hashlib.sha256(data).hexdigest())
                if im.error or not im.coefs:
                    rows.append((None, None, None, *stored, None, None, None, im.error or "no scan"))
                    continue
                feature = f"{im.width}x{im.height}:{difference_hash(thumbnail(im))}"
                carried = (p := restored(im)) if im.payload else None
                payload = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) if carried is not None else (None, None, None)
                rows.append((*payload, *stored, feature, im.width, im.height, None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "error"]
            made = {n: pa.array(list(v), k) for n, v, k in zip(names, zip(*rows, strict=True), kinds, strict=True)}
            yield from pa.table({"id": block.column("id"), **{c: block.column(c) for c in keep}, **made}).combine_chunks().to_batches()

    return frame.mapInArrow(run, schema).withColumnRenamed("id", id_col)
