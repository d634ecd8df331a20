"""Raw coefficients of baseline JPEG files: Huffman decoding without a codec."""

from __future__ import annotations

import re
import struct

import numpy as np

from .image_bytes import ZIGZAG, quantisation_tables


class _Bits:
    """Bits of one restart interval, unstuffed; zeros follow its end."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = raw + bytes(8), 0

    def peek16(self) -> int:
        i, shift = self.at >> 3, self.at & 7
        return (int.from_bytes(self.raw[i : i + 3]) >> (8 - shift)) & 0xFFFF

    def take(self, n: int) -> int:
        i, shift = self.at >> 3, self.at & 7
        self.at += n
        return (int.from_bytes(self.raw[i : i + 4]) >> (32 - shift - n)) & ((1 << n) - 1)


def _lookup(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """Length and symbol for each 16 bits."""
    out, code, at = [(0, 0)] * (1 << 16), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            low = code << (16 - length)
            out[low : low + (1 << (16 - length))] = [(length, symbols[at])] * (1 << (16 - length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _value(bits: _Bits, size: int) -> int:
    v = bits.take(size) if size else 0
    return v - (1 << size) + 1 if size and v < 1 << (size - 1) else v


def coefficients(data: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each component its blocks (rows x columns x 8 x 8 integers) and its quantisation table (8 x 8).

    Any other kind of file, or one whose data end early, is refused.
    """
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    tables = {k: np.array(v).reshape(8, 8) for k, v in quantisation_tables(data).items()}
    at, every, frame, codes = 2, 0, None, {}
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker in (0xC0, 0xC1):
            height, width = struct.unpack_from(">HH", body, 1)
            frame = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                codes[body[i]] = _lookup(body[i + 1 : i + 17], body[i + 17 : i + 17 + n])
                i += 17 + n
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            break
    if not frame or body[0] != len(frame):
        raise ValueError("the components are in several scans")
    end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, at)
    parts = re.split(rb"\xff[\xd0-\xd7]", data[at : end.start() if end else len(data)])
    used = {body[1 + 2 * i]: (codes[body[2 + 2 * i] >> 4], codes[16 | body[2 + 2 * i] & 15]) for i in range(body[0])}
    most_h, most_v = max(f[1] for f in frame), max(f[2] for f in frame)
    columns, lines = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    out = [np.zeros((lines * v, columns * h, 64), np.int32) for _, h, v, _ in frame]
    every = every or columns * lines
    for number, raw in enumerate(parts):
        bits, last = _Bits(raw.replace(b"\xff\x00", b"\xff")), [0] * len(frame)
        for unit in range(number * every, min((number + 1) * every, columns * lines)):
            line, column = divmod(unit, columns)
            for c, (ident, h, v, _) in enumerate(frame):
                dc, ac = used[ident]
                for y in range(v):
                    for x in range(h):
                        block = out[c][line * v + y, column * h + x]
                        length, size = dc[bits.peek16()]
                        bits.at += length
                        last[c] += _value(bits, size)
                        block[0] = last[c]
                        k = 1
                        while k < 64:
                            length, symbol = ac[bits.peek16()]
                            if not length:
                                raise ValueError("broken data")
                            bits.at += length
                            run, size = symbol >> 4, symbol & 15
                            if not size:
                                if run < 15:
                                    break
                                k += 16
                                continue
                            k += run
                            block[ZIGZAG[k]] = _value(bits, size)
                            k += 1
            if bits.at > 8 * len(raw) + 64:
                raise ValueError("the data end early")
    return [o.reshape(*o.shape[:2], 8, 8) for o in out], [tables[q] for *_, q in frame]
