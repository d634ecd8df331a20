"""Progressive JPEG in numpy: many files at once, one symbol of each at a time.

Entropy-coded data is sequential, but restart intervals are independent of each
other. Intervals of all files of a batch are therefore decoded side by side:
a step reads one symbol of every interval with array operations. Spectral
selection and successive approximation fill one table of coefficients (blocks x
64, in zig-zag order) scan by scan; it is then transformed with an exact integer
matrix, so equal files give equal pixels whatever stands beside them.

The encoder writes the same kind of file: YCbCr with chroma at half size, a DC
scan and two spectral bands at half precision, then the scans that refine them.
"""

from __future__ import annotations

import re
import struct
from typing import NamedTuple

import numpy as np

# The zig-zag order of the standard, as the natural place of each coefficient.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: Restart intervals: MCUs of the interleaved DC scans, blocks of the AC scans.
DC_EVERY, AC_EVERY = 32, 4
#: Most MCUs in a column of an image.
TALLEST = 4095
#: Frequencies of the first and the second spectral band.
BANDS = ((1, 5), (6, 63))
LENGTH_MARK = b"length\0"


class Codes(NamedTuple):
    """A Huffman table: code and length of each symbol, and the symbol of each 16 bits."""

    code: np.ndarray
    length: np.ndarray
    lookup: np.ndarray


def huffman(counts: bytes, symbols: bytes) -> Codes:
    """The table of the numbers of codes of length 1 to 16 and their symbols in order."""
    code, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    lookup = np.zeros(1 << 16, np.int64)
    at = now = 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            symbol = symbols[at]
            code[symbol], length[symbol] = now, bits
            lookup[now << (16 - bits) : (now + 1) << (16 - bits)] = bits << 8 | symbol
            now, at = now + 1, at + 1
        now <<= 1
    return Codes(code, length, lookup)


def _table(short: list[int], rest: list[int], bits: int, long: int) -> tuple[bytes, bytes]:
    counts = bytearray(16)
    counts[bits - 1], counts[long - 1] = len(short), len(rest)
    return bytes(counts), bytes(short + rest)


#: Sizes of DC differences; AC runs and sizes: those of dense blocks short, the others longer.
DC_TABLE = _table(list(range(12)), [], 4, 16)
_dense = [*range(1, 9), 0x00, 0xF0, 0x11, 0x12, 0x13, 0x14]
AC_TABLE = _table(_dense, [r << 4 | s for r in range(16) for s in range(11) if (r << 4 | s) not in _dense and (s or r == 15)], 4, 11)
DC_CODES, AC_CODES = huffman(*DC_TABLE), huffman(*AC_TABLE)


def bit_length(x: np.ndarray) -> np.ndarray:
    """Bits of non-negative integers below 2 ** 16."""
    return _BITS[x]


_BITS = np.zeros(1 << 16, np.int64)
for _i in range(16):
    _BITS[1 << _i : 2 << _i] = _i + 1


_SMALL = _BITS[:256].astype(np.uint8)
_CODE32, _LENGTH8 = AC_CODES.code.astype(np.uint32), AC_CODES.length.astype(np.uint8)


# ---------------------------------------------------------------- geometry


class Component(NamedTuple):
    ident: int
    across: int
    down: int
    table: int
    #: Blocks of the component: stored stride and rows, and those of a scan of its own.
    stride: int
    rows: int
    wide: int
    high: int
    #: First block in the file's table.
    first: int


class Frame(NamedTuple):
    width: int
    height: int
    columns: int
    lines: int
    components: tuple[Component, ...]
    blocks: int


def frame(width: int, height: int, parts: tuple[tuple[int, int, int, int], ...]) -> Frame:
    """The layout for components of (ident, across, down, quantisation table)."""
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    columns, lines = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    out, first = [], 0
    for ident, h, v, q in parts:
        stride, rows = columns * h, lines * v
        wide = -(-(-(-width * h // most_h)) // 8)
        high = -(-(-(-height * v // most_v)) // 8)
        out.append(Component(ident, h, v, q, stride, rows, wide, high, first))
        first += stride * rows
    return Frame(width, height, columns, lines, tuple(out), first)


def scan_order(f: Frame, which: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Block and component of every block of a scan in order, and the blocks of one MCU."""
    if len(which) == 1:
        c = f.components[which[0]]
        blocks = c.first + (np.arange(c.high)[:, None] * c.stride + np.arange(c.wide)).ravel()
        return blocks, np.full(len(blocks), which[0]), 1
    line, column = np.divmod(np.arange(f.columns * f.lines), f.columns)
    parts, owner = [], []
    for i in which:
        c = f.components[i]
        for y in range(c.down):
            for x in range(c.across):
                parts.append(c.first + (line * c.down + y) * c.stride + column * c.across + x)
                owner.append(i)
    return np.stack(parts, 1).ravel(), np.tile(owner, f.columns * f.lines), len(parts)


_PARTS = ((1, 2, 2, 0), (2, 1, 1, 1), (3, 1, 1, 1))
_orders: dict = {}


def _payload_frame(n_blocks: int) -> tuple[Frame, np.ndarray]:
    """The frame for so many blocks, six an MCU, and the table's block of each in payload order."""
    mcus = -(-n_blocks // 6)
    columns = -(-mcus // TALLEST)
    key = columns, -(-mcus // columns)
    if key not in _orders:
        if len(_orders) > 512:
            _orders.clear()
        f = frame(16 * key[0], 16 * key[1], _PARTS)
        _orders[key] = f, scan_order(f, (0, 1, 2))[0]
    return _orders[key]


# ---------------------------------------------------------------- encoding


def pack(value: np.ndarray, bits: np.ndarray, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each lane's bits, padded with ones, and the lanes' byte offsets. Lanes are in order."""
    total = np.bincount(lane, bits, lanes).astype(np.int64)
    size = (total + 7) >> 3
    first = np.zeros(lanes + 1, np.int64)
    np.cumsum(size, out=first[1:])
    bits = bits.astype(np.int64)
    before = np.cumsum(bits) - bits
    lane_before = np.zeros(lanes + 1, np.int64)
    np.cumsum(total, out=lane_before[1:])
    at = before - lane_before[lane] + first[lane] * 8
    words = np.zeros((int(first[-1]) >> 3) + 2, np.uint64)

    def put(at: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
        full = bits > 0
        at, value, bits = at[full], value[full], bits[full]
        if not len(at):
            return
        word, room = at >> 6, 64 - (at & 63)
        over = np.maximum(bits - room, 0)
        high = np.where(over > 0, value >> over.astype(np.uint64), value << np.maximum(room - bits, 0).astype(np.uint64))
        start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        words[word[start]] += np.add.reduceat(high, start)
        spill = np.flatnonzero(over)
        words[word[spill] + 1] += value[spill] << (64 - over[spill]).astype(np.uint64)

    put(at, value, bits)
    pad = size * 8 - total
    put(first[:-1] * 8 + total, (np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1), pad)
    return words.astype(">u8").view(np.uint8)[: first[-1]], first


def segments(data: np.ndarray, first: np.ndarray, lane_of_scan: np.ndarray) -> list[bytes]:
    """Entropy-coded data of each scan: stuffed bytes, and restart markers between its lanes."""
    lanes = len(first) - 1
    lane = np.repeat(np.arange(lanes), np.diff(first))
    full = data == 255
    stuffed = np.cumsum(full) - full
    place = np.arange(len(data)) + stuffed + 2 * lane
    total = len(data) + int(full.sum()) + 2 * lanes
    out = np.zeros(total, np.uint8)
    out[place] = data
    end = np.searchsorted(np.arange(len(data)), first[1:])  # lane ends in data
    stuffed_upto = np.append(0, np.cumsum(full))[end]
    mark = first[1:] + stuffed_upto + 2 * np.arange(lanes)
    number = np.arange(lanes) - np.repeat(lane_of_scan[:-1], np.diff(lane_of_scan))
    out[mark] = 255
    out[mark + 1] = 0xD0 + number % 8
    raw, cut = out.tobytes(), np.append(0, mark + 2)
    return [raw[cut[a] : cut[b] - 2] for a, b in zip(lane_of_scan[:-1], lane_of_scan[1:], strict=True)]


def _lanes(per_scan: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray]:
    """Lane of each unit of scans of so many units, and each scan's lanes before it."""
    lanes = -(-per_scan // every)
    before = np.append(0, np.cumsum(lanes))
    inside = np.arange(per_scan.sum()) - np.repeat(np.append(0, np.cumsum(per_scan))[:-1], per_scan)
    return np.repeat(before[:-1], per_scan) + inside // every, before


def _sized(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size category of values, and their extra bits."""
    size = bit_length(np.abs(x))
    return size, np.where(x < 0, x - 1, x).astype(np.int64) & ((1 << size) - 1)


def _dc_first(table: np.ndarray, owner: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    value = table[:, 0].astype(np.int64) >> 1
    diff = value.copy()
    for c in range(3):
        at = np.flatnonzero(owner == c)
        follows = np.append(False, lane[at][1:] == lane[at][:-1])
        diff[at] -= np.where(follows, np.append(0, value[at][:-1]), 0)
    size, extra = _sized(diff)
    return DC_CODES.code[size] << size.astype(np.uint64) | extra.astype(np.uint64), DC_CODES.length[size] + size


def _ac_first(table: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots (blocks x an even width) of bits: each non-zero coefficient's, and the end of the block's."""
    part = table[:, low : high + 1]
    magnitude = np.abs(part) >> 1
    size = _SMALL[magnitude]
    n, width = part.shape
    extra = np.where(part < 0, (np.int32(1) << size) - 1 - magnitude, magnitude).astype(np.uint32)
    symbol = size.astype(np.int64)
    gaps = np.flatnonzero((size == 0).any(axis=1))
    place = np.arange(width)
    at = np.where(size[gaps] > 0, place, -1)
    before = np.maximum.accumulate(np.pad(at, ((0, 0), (1, 0)), constant_values=-1), axis=1)[:, :-1]
    run = np.where(size[gaps] > 0, place - before - 1, 0)
    symbol[gaps] |= (run & 15) << 4
    slots = width + 1 + (width + 1) % 2
    value, bits = np.zeros((n, slots), np.uint64), np.zeros((n, slots), np.uint8)
    value[:, :width] = _CODE32[symbol] << size | extra
    bits[:, :width] = _LENGTH8[symbol] + size
    for i in range(int(run.max(initial=0)) >> 4):  # runs of sixteen zeros before a coefficient
        row, k = np.nonzero(run >> 4 > i)
        value[gaps[row], k] |= AC_CODES.code[0xF0] << bits[gaps[row], k].astype(np.uint64)
        bits[gaps[row], k] += np.uint8(AC_CODES.length[0xF0])
    row, k = np.nonzero(size[gaps] == 0)
    value[gaps[row], k], bits[gaps[row], k] = 0, 0
    ended = size[:, -1] == 0
    value[ended, width], bits[ended, width] = AC_CODES.code[0], AC_CODES.length[0]
    # at most 11 bits of code, 7 more and 12 of runs in a slot: two fit in 64
    return value[:, ::2] << bits[:, 1::2].astype(np.uint64) | value[:, 1::2], bits[:, ::2] + bits[:, 1::2]


def _ac_refine(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots (blocks x 64) of bits: what is said at each coefficient, a group's symbol first."""
    part = table[:, 1:].astype(np.int64)
    size = np.abs(part)
    known, new, zero = size > 1, size == 1, size == 0
    value, bits = (size & 1).astype(np.uint64) * known, known.astype(np.int64)

    def lead(block: np.ndarray, k: np.ndarray, v: np.ndarray, b: np.ndarray) -> None:
        value[block, k] |= v << bits[block, k].astype(np.uint64)
        bits[block, k] += b

    zeros = np.cumsum(zero, axis=1)
    block, k = np.nonzero(new)
    same = np.append(False, block[1:] == block[:-1])
    last = np.where(same, np.append(0, k[:-1]), -1)
    run = zeros[block, k] - np.where(last >= 0, zeros[block, np.maximum(last, 0)], 0)
    start = last + 1
    for i in np.flatnonzero(run > 15):  # every sixteenth zero ends a group of its own
        for _ in range(run[i] >> 4):
            base = zeros[block[i], start[i] - 1] if start[i] else 0
            lead(block[i : i + 1], start[i : i + 1], AC_CODES.code[0xF0:0xF1], AC_CODES.length[0xF0:0xF1])
            start[i] = np.searchsorted(zeros[block[i]], base + 16) + 1
        run[i] &= 15
    symbol = run << 4 | 1
    sign = (part[block, k] > 0).astype(np.uint64)
    lead(block, start, AC_CODES.code[symbol] << np.uint64(1) | sign, AC_CODES.length[symbol] + 1)
    end = np.zeros(len(part), np.int64)
    end[block] = k + 1  # the last one stays
    open_ = np.flatnonzero(end < part.shape[1])
    lead(open_, end[open_], np.repeat(AC_CODES.code[:1], len(open_)), np.repeat(AC_CODES.length[:1], len(open_)))
    return value, bits


def _marker(code: int, body: bytes) -> bytes:
    return bytes((255, code)) + struct.pack(">H", len(body) + 2) + body


def _sos(which: tuple[int, ...], low: int, high: int, ah: int, al: int) -> bytes:
    return _marker(0xDA, bytes([len(which), *(x for c in which for x in (c + 1, 0)), low, high, ah << 4 | al]))


_TABLES = _marker(0xC4, b"\x00" + DC_TABLE[0] + DC_TABLE[1] + b"\x10" + AC_TABLE[0] + AC_TABLE[1])
_QUANT = _marker(0xDB, b"\x00" + bytes([1] * 64) + b"\x01" + bytes([1] * 64))


def _restart(every: int) -> bytes:
    return _marker(0xDD, struct.pack(">H", every))


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG whose coefficients are each payload's bytes less 128, for multiples of 64 bytes.

    Blocks are filled in the order of interleaved MCUs, coefficients in zig-zag
    order; blocks that complete the last MCU are zeros. The payload's length
    stands in a comment.
    """
    n = np.array([len(p) // 64 for p in payloads])
    frames = [_payload_frame(int(x)) for x in n]
    all_blocks = np.array([f.blocks for f, _ in frames])
    base = np.append(0, np.cumsum(all_blocks))
    table = np.zeros((base[-1], 64), np.int16)  # in payload order
    for i, p in enumerate(payloads):
        table[base[i] : base[i] + n[i]] = np.frombuffer(p, np.uint8).reshape(-1, 64).astype(np.int16) - 128
    mcus = all_blocks // 6
    files: list[list[bytes]] = []
    for p, (f, _) in zip(payloads, frames, strict=True):
        sof = struct.pack(">BHHB", 8, f.height, f.width, 3) + bytes(x for c in f.components for x in (c.ident, c.across << 4 | c.down, c.table))
        files.append([b"\xff\xd8", _marker(0xFE, LENGTH_MARK + struct.pack(">Q", len(p))), _QUANT, _marker(0xC2, sof), _TABLES])

    def add(head: bytes, parts: list[bytes]) -> None:
        for out, part in zip(files, parts, strict=True):
            out += (head, part)

    mcu_lane, scan_lanes = _lanes(mcus, DC_EVERY)
    lane = np.repeat(mcu_lane, 6)
    owner = np.tile([0, 0, 0, 0, 1, 2], int(mcus.sum()))
    data, first = pack(*_dc_first(table, owner, lane), lane, int(scan_lanes[-1]))
    add(_restart(DC_EVERY) + _sos((0, 1, 2), 0, 0, 0, 1), segments(data, first, scan_lanes))
    rows = []  # blocks of each component in the order of its own scans
    for c in range(3):
        at = []
        for i, (f, order) in enumerate(frames):
            part = f.components[c]
            if f.columns == 1:  # the payload's order is the component's
                own = base[i] + (np.arange(f.lines)[:, None] * 6 + ((0, 1, 2, 3), (4,), (5,))[c]).ravel()
            else:
                place = np.empty(f.blocks, np.int64)
                place[order] = np.arange(f.blocks)
                own = base[i] + place[part.first : part.first + part.stride * part.rows]
            at.append(own)
        rows.append((np.concatenate(at), np.array([len(x) for x in at])))
    heads = _restart(AC_EVERY)
    for low, high in BANDS:
        for c, (at, count) in enumerate(rows):
            value, bits = _ac_first(table[at], low, high)
            _add_blocks(value, bits, count, add, heads + _sos((c,), low, high, 0, 1))
            heads = b""
    lane_bits = (table[:, 0] & 1).astype(np.uint64)
    data, first = pack(lane_bits, np.ones(len(lane_bits), np.int64), lane, int(scan_lanes[-1]))
    add(_restart(DC_EVERY) + _sos((0, 1, 2), 0, 0, 1, 0), segments(data, first, scan_lanes))
    heads = _restart(AC_EVERY)
    for c, (at, count) in enumerate(rows):
        value, bits = _ac_refine(table[at])
        value, bits = np.pad(value, ((0, 0), (0, 1))), np.pad(bits, ((0, 0), (0, 1)))
        # four slots hold at most 4 * 13 bits, and 12 for each group of zeros that ends in one of them
        if int(bits.reshape(-1, 4).sum(1).max(initial=0)) <= 64:
            v, b = value[:, 3::4].copy(), bits[:, 3::4].copy()
            for i in (2, 1, 0):
                v |= value[:, i::4] << np.minimum(b, 63).astype(np.uint64)
                b += bits[:, i::4]
            value, bits = v, b
        _add_blocks(value, bits, count, add, heads + _sos((c,), 1, 63, 1, 0))
        heads = b""
    return [b"".join([*out, b"\xff\xd9"]) for out in files]


def _add_blocks(value: np.ndarray, bits: np.ndarray, count: np.ndarray, add, head: bytes) -> None:
    lane, scan_lanes = _lanes(count, AC_EVERY)
    data, first = pack(value.ravel(), bits.ravel(), np.repeat(lane, value.shape[1]), int(scan_lanes[-1]))
    add(head, segments(data, first, scan_lanes))


# ---------------------------------------------------------------- decoding


class Scan(NamedTuple):
    which: tuple[int, ...]
    tables: tuple[tuple[bytes, bytes] | None, ...]
    low: int
    high: int
    ah: int
    al: int
    every: int
    start: int
    end: int


class File(NamedTuple):
    raw: bytes
    frame: Frame
    quant: dict[int, np.ndarray]
    scans: list[Scan]
    length: int | None


_ENTROPY_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def parse(raw: bytes) -> File:
    """Headers and scans of a progressive JPEG; anything else is refused."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, every, length, found = 2, 0, None, None
    quant: dict[int, np.ndarray] = {}
    codes: dict[int, tuple[bytes, bytes]] = {}
    scans: list[Scan] = []
    while True:
        while raw[at : at + 2] == b"\xff\xff":
            at += 1
        code = raw[at + 1]
        if code == 0xD9:
            break
        size = raw[at + 2] << 8 | raw[at + 3]
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if code == 0xC2:
            height, width = struct.unpack(">HH", body[1:5])
            parts = tuple((body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3))
            found = frame(width, height, parts)
        elif 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a progressive JPEG with Huffman codes")
        elif code == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                codes[body[i]] = body[i + 1 : i + 17], body[i + 17 : i + 17 + n]
                i += 17 + n
        elif code == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                kind = ">u2" if wide else np.uint8
                quant[body[i] & 15] = np.frombuffer(body, kind, 64, i + 1).astype(np.int64)
                i += 65 + 64 * wide
        elif code == 0xDD:
            every = body[0] << 8 | body[1]
        elif code == 0xFE and body.startswith(LENGTH_MARK):
            length = struct.unpack(">Q", body[len(LENGTH_MARK) :])[0]
        elif code == 0xDA:
            n = body[0]
            names = [c.ident for c in found.components]
            which = tuple(names.index(body[1 + 2 * i]) for i in range(n))
            low, high, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
            tables = tuple(codes.get(body[2 + 2 * i] >> 4 if not low else 16 | body[2 + 2 * i] & 15) for i in range(n))
            end = _ENTROPY_END.search(raw, at)
            stop = end.start() if end else len(raw)
            scans.append(Scan(which, tables, low, high, al >> 4, al & 15, every, at, stop))
            at = stop
    return File(raw, found, quant, scans, length)


class Lanes(NamedTuple):
    """Intervals of scans that are decoded side by side."""

    window: np.ndarray  # 32 bits from each byte on
    bit: np.ndarray  # first bit of each lane
    order: np.ndarray  # block of every unit, all lanes together
    owner: np.ndarray  # component of every unit of a DC scan
    first: np.ndarray  # units before each lane
    table: np.ndarray  # Huffman table of every unit of a DC scan, of each lane of an AC scan


def peek(window: np.ndarray, at: np.ndarray, n) -> np.ndarray:
    """The next n bits (at most 16, which may differ) from each bit on."""
    return ((window[at >> 3] << (at & 7)) & 0xFFFFFFFF) >> (32 - n)


def _gather(files: list[File], base: np.ndarray, scans: list[tuple[int, Scan]], tables: dict) -> Lanes:
    cache: dict = {}
    orders, owners, kinds, units, per_lane = [], [], [], [], []
    for i, s in scans:
        f = files[i].frame
        key = f.columns, f.lines, f.width, f.height, s.which
        if (key, f.components) not in cache:
            cache[key, f.components] = scan_order(f, s.which)
        order, owner, mcu = cache[key, f.components]
        orders.append(order)
        units.append(len(order))
        per_lane.append(s.every * mcu if s.every else max(1, len(order)))
        numbers = [tables.setdefault(t, len(tables)) if t else 0 for t in s.tables]
        if s.low == 0:
            owners.append(owner)
            by_owner = np.zeros(len(f.components), np.int64)
            by_owner[list(s.which)] = numbers
            kinds.append(by_owner[owner])
        else:
            kinds.append(numbers[0])
    units, per_lane = np.array(units), np.array(per_lane)
    lanes = np.maximum(-(-units // per_lane), 1)
    raw = np.frombuffer(b"".join([files[i].raw[s.start : s.end] for i, s in scans]) + bytes(8), np.uint8)
    start = np.append(0, np.cumsum([s.end - s.start for _, s in scans]))[:-1]
    full = np.flatnonzero(raw == 255)
    after = raw[full + 1]
    marks = full[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(raw), bool)
    keep[full[after == 0] + 1] = keep[marks] = keep[marks + 1] = False
    gone = np.cumsum(~keep)
    begin = np.sort(np.concatenate([start, marks + 2]))
    if len(begin) != lanes.sum():
        raise ValueError("restart markers are missing")
    begin -= np.where(begin > 0, gone[begin - 1], 0)
    every = raw[keep].astype(np.int64)
    window = every[:-3] << 24 | every[1:-2] << 16 | every[2:-1] << 8 | every[3:]
    inside = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    before = np.repeat(np.cumsum(units) - units, lanes) + np.minimum(inside * np.repeat(per_lane, lanes), np.repeat(units, lanes))
    order = np.concatenate(orders) + np.repeat(base[[i for i, _ in scans]], units)
    first = np.append(before, units.sum())
    if owners:
        return Lanes(window, begin * 8, order, np.concatenate(owners), first, np.concatenate(kinds))
    return Lanes(window, begin * 8, order, order, first, np.repeat(kinds, lanes))


def _extended(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits)


def _read_dc(table: np.ndarray, x: Lanes, s: Scan, lookup: np.ndarray) -> None:
    if s.ah:
        n = np.diff(x.first)
        inside = np.arange(x.first[-1]) - np.repeat(x.first[:-1], n)
        table[x.order, 0] |= (peek(x.window, np.repeat(x.bit, n) + inside, 1) << s.al).astype(table.dtype)
        return
    at, unit, end = x.bit.copy(), x.first[:-1].copy(), x.first[1:]
    known = np.zeros((len(at), 4), np.int64)
    live = np.flatnonzero(unit < end)
    while len(live):
        u, a = unit[live], at[live]
        found = lookup[x.table[u] << 16 | peek(x.window, a, 16)]
        size = found & 255
        a = a + (found >> 8)
        c = x.owner[u]
        value = known[live, c] + _extended(peek(x.window, a, size), size)
        known[live, c] = value
        table[x.order[u], 0] = value << s.al
        at[live], unit[live] = a + size, u + 1
        live = live[u + 1 < end[live]]


def _read_ac_first(table: np.ndarray, x: Lanes, s: Scan, lookup: np.ndarray) -> None:
    flat = table.reshape(-1)
    live = np.flatnonzero(x.first[:-1] < x.first[1:])
    a, u, end, kind = x.bit[live], x.first[:-1][live], x.first[1:][live], x.table[live] << 16
    k = np.full(len(live), s.low)
    while len(a):
        found = lookup[kind | peek(x.window, a, 16)]
        a = a + (found >> 8)
        run, size = found >> 4 & 15, found & 15
        bits = peek(x.window, a, np.where(size > 0, size, run))
        value = size > 0
        at = k + run
        place = np.flatnonzero(value)
        flat[x.order[u[place]] * 64 + at[place]] = _extended(bits[place], size[place]) << s.al
        a = a + np.where(value, size, np.where(run < 15, run, 0))
        ended = ~value & (run < 15)
        k = np.where(ended, s.high + 1, at + 1)
        done = k > s.high
        u = u + np.where(ended, (1 << run) + np.where(run > 0, bits, 0), done)
        k[done] = s.low
        if done.any() and (keep := u < end).sum() < len(a):
            a, u, end, kind, k = a[keep], u[keep], end[keep], kind[keep], k[keep]


def _read_ac_refine(table: np.ndarray, x: Lanes, s: Scan, lookup: np.ndarray) -> None:
    live = np.flatnonzero(x.first[:-1] < x.first[1:])
    a, u, end, kind = x.bit[live], x.first[:-1][live], x.first[1:][live], x.table[live] << 16
    k, left = np.full(len(live), s.low), np.zeros(len(live), np.int64)  # left: blocks of an end-of-band run
    places = np.arange(s.low, s.high + 1)
    one = 1 << s.al
    while len(a):
        found = lookup[kind | peek(x.window, a, 16)]
        fresh = left == 0
        a = a + np.where(fresh, found >> 8, 0)
        run, size = found >> 4 & 15, found & 15
        bits = peek(x.window, a, np.where(size > 0, 1, run))
        value = fresh & (size > 0)
        ended = fresh & (size == 0) & (run < 15)
        new = np.where(value, np.where(bits > 0, one, -one), 0)
        a = a + np.where(value, 1, np.where(ended, run, 0))
        left = np.where(ended, (1 << run) + np.where(run > 0, bits, 0), left)
        block = x.order[u]
        part = table[block, s.low : s.high + 1].astype(np.int64)
        old = part != 0
        ahead = places >= k[:, None]
        # a run stops at the zero after so many zeros, the end of a band after the last coefficient
        zeros = np.cumsum(~old & ahead, axis=1)
        stop = np.where(left > 0, s.high + 1, s.low + (zeros <= run[:, None]).sum(1))
        fix = old & ahead & (places < stop[:, None])
        nth = np.cumsum(fix, axis=1) - 1
        lane, column = np.nonzero(fix)
        said = peek(x.window, a[lane] + nth[lane, column], 1)
        was = part[lane, column]
        part[lane, column] = was + np.where((said > 0) & (np.abs(was) & one == 0), np.where(was > 0, one, -one), 0)
        put = np.flatnonzero((new != 0) & (stop <= s.high))
        part[put, stop[put] - s.low] = new[put]
        table[block, s.low : s.high + 1] = part
        a = a + fix.sum(1)
        k = np.where(left > 0, s.high + 1, stop + 1)
        done = k > s.high
        left = np.where(done & (left > 0), left - 1, left)
        k = np.where(done, s.low, k)
        u = u + done
        if done.any() and (keep := u < end).sum() < len(a):
            a, u, end, kind, k, left = a[keep], u[keep], end[keep], kind[keep], k[keep], left[keep]


def coefficients(files: list[File]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (blocks x 64, zig-zag) of all files together, and the blocks before each file."""
    base = np.append(0, np.cumsum([f.frame.blocks for f in files]))
    table = np.zeros((base[-1], 64), np.int32)
    at = [0] * len(files)
    while True:
        # the next scans of each file that agree in kind; scans of other components may come along
        waves: dict[tuple, list[tuple[int, Scan]]] = {}
        for i, f in enumerate(files):
            if at[i] < len(f.scans):
                key = None
                seen: set[int] = set()
                while at[i] < len(f.scans):
                    s = f.scans[at[i]]
                    own = s.low == 0, s.low, s.high, s.ah, s.al
                    if (key is not None and own != key) or seen & set(s.which):
                        break
                    key = own
                    seen |= set(s.which)
                    waves.setdefault(own, []).append((i, s))
                    at[i] += 1
        if not waves:
            return table, base
        for scans in waves.values():
            tables: dict = {}
            x = _gather(files, base, scans, tables)
            s = scans[0][1]
            lookup = np.concatenate([huffman(*t).lookup if t != AC_TABLE else AC_CODES.lookup for t in tables] or [np.zeros(1 << 16, np.int64)])
            if s.low == 0:
                _read_dc(table, x, s, lookup)
            elif s.ah == 0:
                _read_ac_first(table, x, s, lookup)
            else:
                _read_ac_refine(table, x, s, lookup)


def payload(f: File, table: np.ndarray) -> bytes:
    """The bytes that ``encode`` stored, from a file's coefficients."""
    _, order = _payload_frame(f.length // 64)
    return (table[order[: f.length // 64]] + 128).astype(np.uint8).tobytes()


#: Fixed-point bits of each of the two passes of the inverse transform.
_POINT = 13
_basis = np.array([[(0.5 if u else 0.5**1.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
_basis = np.rint(_basis * (1 << _POINT))
#: Pixels (64, by rows) of each coefficient in zig-zag order: integers, so products in float64 are exact.
_INVERSE = np.einsum("ay,bx->abyx", _basis, _basis).reshape(64, 64)[ZIGZAG]


def samples(table: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8 x 8 samples (0 to 255) of each block."""
    exact = (table * quant).astype(np.float64) @ _INVERSE
    return np.clip(np.floor(exact / (1 << 2 * _POINT) + 0.5) + 128, 0, 255).astype(np.uint8)


def plane(blocks: np.ndarray, stride: int) -> np.ndarray:
    return blocks.reshape(-1, stride, 8, 8).transpose(0, 2, 1, 3).reshape(-1, stride * 8)


def tensor(f: File, blocks: np.ndarray) -> np.ndarray:
    """The full-resolution RGB image (height x width x 3) of a file's sample blocks; chroma is repeated."""
    most_h, most_v = max(c.across for c in f.frame.components), max(c.down for c in f.frame.components)
    planes = []
    for c in f.frame.components:
        p = plane(blocks[c.first : c.first + c.stride * c.rows], c.stride)
        if (c.down, c.across) != (most_v, most_h):
            p = p.repeat(most_v // c.down, axis=0).repeat(most_h // c.across, axis=1)
        planes.append(p[: f.frame.height, : f.frame.width].astype(np.int32))
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, axis=2).astype(np.uint8)
    y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
    half = 1 << 15
    # 1.402, 0.344136, 0.714136 and 1.772 times 2 ** 16.
    r = (y + 91881 * cr + half) >> 16
    g = (y - 22554 * cb - 46802 * cr + half) >> 16
    b = (y + 116130 * cb + half) >> 16
    return np.clip(np.stack([r, g, b], axis=2), 0, 255).astype(np.uint8)


def decode(raws: list[bytes]) -> tuple[list[File], list[np.ndarray], list[np.ndarray]]:
    """Headers, coefficients (blocks x 64, zig-zag) and RGB tensor of each file."""
    files = [parse(r) for r in raws]
    if not files:
        return [], [], []
    table, base = coefficients(files)
    quant = np.concatenate([np.repeat(np.stack([f.quant[c.table] for c in f.frame.components]), [c.stride * c.rows for c in f.frame.components], axis=0) for f in files])
    pixels = samples(table, quant)
    tables = [table[a:b] for a, b in zip(base[:-1], base[1:], strict=True)]
    return files, tables, [tensor(f, pixels[a:b]) for f, a, b in zip(files, base[:-1], base[1:], strict=True)]
