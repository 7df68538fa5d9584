"""Baseline JPEG frames (8 bits, Huffman), encoded and decoded many at a time.

Restart markers cut a scan into segments that decode alone.  All segments of all frames of a call advance side by side:
one step reads one symbol of every segment.  A payload is stored losslessly as quantised coefficients, a byte in each,
with a quantiser of ones; pixels come from an exact fixed-point inverse transform.
"""

from __future__ import annotations

import functools
import struct
from dataclasses import dataclass

import numpy as np

# The standard's default Huffman tables (code counts by length 1 to 16; symbols).  Of the AC symbols the
# irregular beginning is listed; the others follow in ascending order.
DC_COUNTS = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0))
AC_COUNTS = ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119))
AC_FIRST = (
    bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282"),
    bytes.fromhex("0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f1"),
)


def _ac_symbols(which: int) -> bytes:
    first = AC_FIRST[which]
    every = sorted({0x00, 0xF0} | {run << 4 | size for run in range(16) for size in range(1, 11)})
    return first + bytes(s for s in every if s not in first)


def default_tables() -> dict[tuple[int, int], tuple[tuple, bytes]]:
    """(class, id) -> (counts, symbols), as motion-JPEG frames without tables use them."""
    return {(0, i): (DC_COUNTS[i], bytes(range(12))) for i in (0, 1)} | {(1, i): (AC_COUNTS[i], _ac_symbols(i)) for i in (0, 1)}


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([y * 8 + x for y, x in cells])


ZIGZAG = _zigzag()


@functools.lru_cache(64)
def _codes(counts: tuple, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length)."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


@functools.lru_cache(64)
def _lookup(counts: tuple, symbols: bytes) -> np.ndarray:
    """length << 8 | symbol for every 16 bits; 0: no code."""
    out = np.zeros(1 << 16, np.int64)
    for symbol, code, length in _codes(counts, symbols):
        out[code << 16 - length : (code + 1) << 16 - length] = length << 8 | symbol
    return out


#: Coefficients that can be written: -LIMIT + 1 to LIMIT - 1.
LIMIT = 1 << 10


@functools.lru_cache(4)
def _writer(kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits (code, then value) and their number, by run * 2 LIMIT + value + LIMIT."""
    codes = {symbol: (code, length) for symbol, code, length in _codes(*default_tables()[kind, 0])}
    bits, lengths = np.zeros(16 * 2 * LIMIT, np.int32), np.zeros(16 * 2 * LIMIT, np.int32)
    for run in range(16 if kind else 1):
        for size in range(11):
            if (found := codes.get(run << 4 | size)) is None:
                continue
            for value in ([0] if not size else [*range(-(1 << size) + 1, -(1 << size - 1) + 1), *range(1 << size - 1, 1 << size)]):
                at = run * 2 * LIMIT + value + LIMIT
                bits[at], lengths[at] = found[0] << size | (value if value >= 0 else value + (1 << size) - 1), found[1] + size
    return bits, lengths


def header(width: int, height: int) -> bytes:
    """Everything before the scan: one component, quantiser of ones, a restart after every block, default tables."""
    return (
        b"\xff\xd8"
        + b"\xff\xe0\x00\x10AVI1\0" + bytes(9)
        + b"\xff\xdb\x00\x43\x00" + b"\x01" * 64
        + b"\xff\xc0" + struct.pack(">HBHHB3B", 11, 8, height, width, 1, 1, 0x11, 0)
        + b"\xff\xdd" + struct.pack(">HH", 4, 1)
        + b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 0, 63, 0)
    )


def encode_frames(blocks: np.ndarray, per_frame: int, width: int, height: int) -> list[bytes]:
    """Frames of ``per_frame`` blocks each; blocks: (n, 64) coefficients in zigzag order, within LIMIT."""
    n = len(blocks)
    (dc_bits, dc_lengths), (ac_bits, ac_lengths) = _writer(0), _writer(1)
    # AC symbols in order: the coefficient's place among its block's symbols also counts runs of 16 zeros
    flat = np.ascontiguousarray(blocks[:, 1:]).reshape(-1)
    nonzero = np.flatnonzero(flat)
    row = (nonzero // 63).astype(np.int32)
    before = np.concatenate([[-1], nonzero[:-1]])
    run = (nonzero - np.maximum(before, nonzero // 63 * 63 - 1) - 1).astype(np.int32)
    long = run >> 4
    symbol = (run & 15) * (2 * LIMIT) + flat[nonzero] + LIMIT
    each = np.bincount(row, minlength=n)
    last = np.full(n, -1)
    last[row] = nonzero
    ends = last % 63 < 62
    ends[each == 0] = True
    plain = not long.any()
    count = 1 + (each if plain else np.bincount(row, 1 + long, n).astype(np.int64)) + ends
    begin = np.concatenate([[0], np.cumsum(count)])
    total = int(begin[-1])
    code, length = np.full(total, ac_bits[LIMIT], np.int32), np.full(total, ac_lengths[LIMIT], np.int32)  # ends of blocks stay
    dc = blocks[:, 0].astype(np.int64) + LIMIT
    code[begin[:-1]], length[begin[:-1]] = dc_bits[dc], dc_lengths[dc]
    is_ac = np.ones(total, bool)
    is_ac[begin[:-1]] = False
    is_ac[begin[1:][ends] - 1] = False
    if plain:
        at = np.flatnonzero(is_ac)
    else:
        at = np.flatnonzero(is_ac)[np.cumsum(1 + long) - 1]
        zeros = 15 * 2 * LIMIT + LIMIT
        for extra in range(1, 4):
            runs = at[long >= extra] - extra
            code[runs], length[runs] = ac_bits[zeros], ac_lengths[zeros]
    code[at], length[at] = ac_bits[symbol], ac_lengths[symbol]
    # bits: every block begins with a byte and ends in ones
    bits = np.concatenate([[0], np.cumsum(length)])
    in_block = bits[begin[1:]] - bits[begin[:-1]]
    size = -(-in_block // 8)
    start = np.concatenate([[0], np.cumsum(size)])
    offset = bits[:-1] + np.repeat(start[:-1] * 8 - bits[begin[:-1]], count)
    spans = 4 if length.max() <= 25 else 5
    byte = offset >> 3
    spread = code.astype(np.int64) << (8 * spans - (offset & 7) - length)
    data = np.zeros(int(start[-1]) + 5)
    for k in range(spans):
        part = (spread >> (8 * (spans - 1 - k))) & 255
        if k < 2:
            data[k:] += np.bincount(byte, part, len(data))[: len(data) - k]
        else:  # few symbols are that long
            some = np.flatnonzero(part)
            data[k:] += np.bincount(byte[some], part[some], len(data))[: len(data) - k]
    data = data[: int(start[-1])].astype(np.uint8)
    data[start[1:] - 1] |= ((1 << (size * 8 - in_block)) - 1).astype(np.uint8)
    # stuffing and restart markers
    full = data == 255
    frame, inside = np.arange(n) // per_frame, np.arange(n) % per_frame
    markers = np.repeat(np.arange(n) - frame, size)
    to = np.arange(len(data)) + np.cumsum(full) - full + 2 * markers
    out = np.zeros(len(data) + int(full.sum()) + 2 * int(n - 1 - frame[-1]), np.uint8)
    out[to] = data
    head = to[start[:-1]]
    marked = np.flatnonzero(inside > 0)
    out[head[marked] - 2], out[head[marked] - 1] = 255, 0xD0 + (inside[marked] - 1) % 8
    cuts = [*head[inside == 0].tolist(), len(out)]
    before_scan, raw = header(width, height), out.tobytes()
    return [b"".join((before_scan, raw[a:b], b"\xff\xd9")) for a, b in zip(cuts, cuts[1:])]


@dataclass(frozen=True)
class Layout:
    """What a frame's header says; equal headers share one."""

    width: int
    height: int
    #: (horizontal, vertical sampling, DC lookup key, AC lookup key), per component
    components: tuple
    quantiser: bytes
    restart: int
    tables: tuple

    @property
    def units(self) -> tuple[int, int]:
        h, v = max(c[0] for c in self.components), max(c[1] for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    @property
    def plan(self) -> list[int]:
        """Component of each block of a unit."""
        return [i for i, c in enumerate(self.components) for _ in range(c[0] * c[1])]


def parse_header(frame: bytes) -> tuple[Layout, int]:
    """Layout and where the scan begins; raises ValueError for what isn't a baseline frame."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at, quantisers, tables, restart, size, parts = 2, {}, default_tables(), 0, None, {}
    while at + 4 <= len(frame):
        if frame[at] != 255:
            raise ValueError("marker expected")
        marker = frame[at + 1]
        if marker == 255:
            at += 1
            continue
        length = frame[at + 2] << 8 | frame[at + 3]
        body = frame[at + 4 : at + 2 + length]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                values = struct.unpack(">64H", body[1:129]) if wide else tuple(body[1:65])
                quantisers[body[0] & 15] = values
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                counts = tuple(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = counts, body[17 : 17 + sum(counts)]
                body = body[17 + sum(counts) :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("8 bits only")
            size = struct.unpack(">HH", body[1:5])
            parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("baseline frames only")
        elif marker == 0xDD:
            restart = body[0] << 8 | body[1]
        elif marker == 0xDA:
            if size is None or body[0] != len(parts):
                raise ValueError("one scan with all components is needed")
            chosen = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            components = tuple((1, 1, (0, d), (1, a)) if len(parts) == 1 else (*parts[c][:2], (0, d), (1, a)) for c, d, a in chosen)
            first = quantisers.get(parts[chosen[0][0]][2])
            if first is None:
                raise ValueError("no quantiser")
            return Layout(size[1], size[0], components, struct.pack(">64H", *first), restart, tuple(sorted((k, v) for k, v in tables.items()))), at + 2 + length
        at += 2 + length
    raise ValueError("no scan")


class Decoder:
    """Remembers headers, as frames of a stream mostly share one."""

    def __init__(self) -> None:
        self.known: dict[bytes, Layout] = {}
        self.lengths: list[int] = []

    def layout(self, frame: bytes) -> tuple[Layout, int]:
        for n in self.lengths:
            if found := self.known.get(frame[:n]):
                return found, n
        layout, n = parse_header(frame)
        if len(self.known) > 256:
            self.known.clear()
            self.lengths = []
        self.known[frame[:n]] = layout
        if n not in self.lengths:
            self.lengths.append(n)
        return layout, n

    def luma(self, frames: list[bytes]) -> list[tuple[Layout, np.ndarray]]:
        """Layout and first component's coefficients (blocks, 64; zigzag; in coding order) of each frame."""
        out: list = [None] * len(frames)
        groups: dict[Layout, list[tuple[int, int]]] = {}
        for i, frame in enumerate(frames):
            layout, begin = self.layout(frame)
            groups.setdefault(layout, []).append((i, begin))
        for layout, members in groups.items():
            found = _decode(layout, [frames[i][begin:] for i, begin in members])
            for (i, _), blocks in zip(members, found):
                out[i] = layout, blocks
        return out


def _decode(layout: Layout, scans: list[bytes]) -> np.ndarray:
    """(frames, blocks, 64) coefficients of the first component; ``scans`` end with the end-of-image marker."""
    data = np.frombuffer(b"".join(scans), np.uint8)
    ends = np.cumsum([len(s) for s in scans])
    full = np.flatnonzero(data[:-1] == 255)
    follows = data[full + 1]
    keep = np.ones(len(data), bool)
    keep[full[follows == 0] + 1] = False
    marks = full[follows != 0]
    keep[marks] = keep[marks + 1] = False
    resets = marks[(data[marks + 1] & 0xF8) == 0xD0] + 2
    starts = np.sort(np.concatenate([[0], ends[:-1], resets]))
    frame = np.searchsorted(ends, starts, "right")
    moved = np.concatenate([[0], np.cumsum(keep)])
    pos = moved[starts] * 8
    packed = np.concatenate([data[keep], np.zeros(8, np.uint8)]).astype(np.uint64)
    m = len(packed) - 5
    window = packed[:m] << np.uint64(56) | packed[1 : m + 1] << np.uint64(48) | packed[2 : m + 2] << np.uint64(40) | packed[3 : m + 3] << np.uint64(32) | packed[4 : m + 4] << np.uint64(24)
    across, down = layout.units
    units, plan, tables = across * down, layout.plan, dict(layout.tables)
    per_segment = layout.restart or units
    in_frame = np.arange(len(starts)) - np.searchsorted(frame, frame)
    left = np.minimum(units - in_frame * per_segment, per_segment)
    own = [k for k, c in enumerate(plan) if c == 0]
    out = np.zeros((len(scans), units * len(own), 64), np.int16)
    dc = np.zeros((len(layout.components), len(starts)), np.int64)

    def symbols(which: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of these segments and the values that follow; moves them on."""
        p = pos[which]
        bits = window[np.minimum(p >> 3, m - 1)] << (p & 7).astype(np.uint64)
        found = table[(bits >> np.uint64(48)).astype(np.int64)]
        length, symbol = found >> 8, found & 255
        size = symbol & 15
        value = (bits << length.astype(np.uint64) >> np.uint64(1) >> (np.uint64(63) - size.astype(np.uint64))).astype(np.int64)
        value -= np.where(value < (1 << size >> 1), (1 << size) - 1, 0)
        pos[which] = p + np.maximum(length, 1) + size
        return symbol, value

    for unit in range(int(left.max(initial=0))):
        live = np.flatnonzero(left > unit)
        for k, c in enumerate(plan):
            _, _, dc_key, ac_key = layout.components[c]
            _, value = symbols(live, _lookup(*tables[dc_key]))
            dc[c, live] += value
            target = (frame[live], (in_frame[live] * per_segment + unit) * len(own) + k) if c == 0 else None
            if target:
                out[target[0], target[1], 0] = dc[0, live]
            which, at, index = live, np.zeros(len(live), np.int64), np.arange(len(live))
            while len(which):
                symbol, value = symbols(which, _lookup(*tables[ac_key]))
                at = at + 1 + (symbol >> 4)
                good = ((symbol & 15) > 0) & (at < 64)
                if target:
                    if good.all():
                        out[target[0][index], target[1][index], at] = value
                    else:
                        g = index[good]
                        out[target[0][g], target[1][g], at[good]] = value[good]
                more = (at < 63) & ((symbol == 0xF0) | good)
                if not more.all():
                    which, at, index = which[more], at[more], index[more]
    return out


@functools.lru_cache(1)
def _basis() -> np.ndarray:
    """8-point inverse transform times 2**13, in whole numbers: products of those stay exact in 53 bits."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.where(u == 0, np.sqrt(0.125), 0.5)
    return np.round(c * np.cos((2 * x + 1) * u * np.pi / 16) * (1 << 13))


def pixels(layout: Layout, blocks: np.ndarray) -> np.ndarray:
    """(n, 64) pixel values of blocks of coefficients."""
    scaled = np.zeros((len(blocks), 64))
    scaled[:, ZIGZAG] = blocks * np.array(struct.unpack(">64H", layout.quantiser), float)
    basis = _basis()
    rows = (scaled.reshape(-1, 8) @ basis).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ basis
    exact = rows.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 64)
    return np.clip(np.floor((exact + (1 << 25)) / (1 << 26)) + 128, 0, 255).astype(np.uint8)
