"""What the bytes of an image file say without decoding it: segments, EXIF, XMP, ICC, quantisation tables."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np

# EXIF tags of the summary, and the types of TIFF values with their sizes.
TAGS = {
    0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright",
    0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0xA431: "BodySerialNumber", 0xA434: "LensModel", 0x829A: "ExposureTime", 0x829D: "FNumber",
    0x8827: "ISOSpeedRatings", 0x920A: "FocalLength", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight",
}
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 7: ("B", 1), 9: ("i", 4), 10: ("ii", 8)}
EXIF_POINTER, GPS_POINTER = 0x8769, 0x8825
# Terms that hint at content credentials.
CREDENTIAL_TERMS = (b"c2pa", b"urn:c2pa", b"jumbf", b"contentcredentials", b"content credentials")
# How far a file is searched, how many tags are shown, and how long an XMP packet without an end is taken to be. None is no bound.
SCAN = 16 << 20
MOST_TAGS, XMP_WINDOW = 64, 8192
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))


def segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Marker and body of each segment of a JPEG up to its first scan; nothing of other files."""
    if data[:2] != b"\xff\xd8":
        return
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0xD9, 0xDA):
            return
        size = data[at + 2] << 8 | data[at + 3]
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


def quantisation_tables(data: bytes) -> dict[int, list[int]]:
    """Tables of a JPEG by number, in row order."""
    out: dict[int, list[int]] = {}
    for marker, body in segments(data):
        at = 0
        while marker == 0xDB and at < len(body):
            wide, number = body[at] >> 4, body[at] & 15
            values = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1)
            table = [0] * 64
            for place, value in zip(ZIGZAG, values.tolist(), strict=True):
                table[place] = value
            out[number] = table
            at += 65 + 64 * (wide > 0)
    return out


def _entries(tiff: bytes, offset: int, order: str) -> Iterator[tuple[int, object]]:
    if offset + 2 > len(tiff):
        return
    (count,) = struct.unpack_from(order + "H", tiff, offset)
    for i in range(count):
        at = offset + 2 + 12 * i
        if at + 12 > len(tiff):
            return
        tag, kind, n = struct.unpack_from(order + "HHI", tiff, at)
        form, size = TYPES.get(kind, (None, 0))
        if not form:
            continue
        place = at + 8 if n * size <= 4 else struct.unpack_from(order + "I", tiff, at + 8)[0]
        if place + n * size > len(tiff):
            continue
        if form == "s":
            yield tag, tiff[place : place + n].split(b"\0")[0].decode("utf-8", "ignore").strip()
        else:
            values = struct.unpack_from(order + form * n, tiff, place)
            if len(form) == 2:
                values = [a / b if b else 0.0 for a, b in zip(values[::2], values[1::2], strict=True)]
            yield tag, values[0] if len(values) == 1 else list(values)


def exif(data: bytes, most: int | None = MOST_TAGS) -> dict[str, object]:
    """EXIF values by name, the first ``most`` (all of them with no bound), with the position in degrees if there is one."""
    for marker, body in segments(data):
        if marker != 0xE1 or not body.startswith(b"Exif\0\0"):
            continue
        tiff = body[6:]
        order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
        if not order or len(tiff) < 8:
            return {}
        found = dict(_entries(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order))
        if isinstance(found.get(EXIF_POINTER), int):
            found |= dict(_entries(tiff, found[EXIF_POINTER], order))
        out = {TAGS.get(t, f"Tag_{t}"): v for t, v in found.items() if t not in (EXIF_POINTER, GPS_POINTER) and v not in (None, "")}
        if isinstance(found.get(GPS_POINTER), int):
            gps = dict(_entries(tiff, found[GPS_POINTER], order))
            for name, ref, value in (("latitude", 1, 2), ("longitude", 3, 4)):
                dms = gps.get(value)
                if isinstance(dms, list) and len(dms) == 3:
                    degrees = dms[0] + dms[1] / 60 + dms[2] / 3600
                    out[name] = round(-degrees if str(gps.get(ref)).upper() in ("S", "W") else degrees, 7)
        return dict(list(out.items())[:most])
    return {}


def xmp(data: bytes, scan: int | None = SCAN, window: int | None = XMP_WINDOW) -> str | None:
    """The XMP packet: that of its own segment, else what looks like one in the first bytes (all of them with no bound)."""
    for marker, body in segments(data):
        if marker == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
            return body[29:].decode("utf-8", "ignore")
    text = data[:scan].decode("utf-8", "ignore")
    start = max(text.find("<x:xmpmeta"), -1)
    start = text.find("<xmpmeta") if start < 0 else start
    if start < 0:
        return None
    end = text.find("</x:xmpmeta>", start)
    return text[start : end + 12] if end >= 0 else text[start:][:window]


def icc(data: bytes) -> tuple[int, str | None]:
    """Size of the colour profile and its description; (0, None) without one."""
    raw = b"".join(body[14:] for marker, body in segments(data) if marker == 0xE2 and body.startswith(b"ICC_PROFILE\0"))
    at = raw.find(b"desc\0\0\0\0")
    if at < 0 or at + 12 > len(raw):
        return len(raw), None
    n = struct.unpack_from(">I", raw, at + 8)[0]
    return len(raw), raw[at + 12 : at + 12 + max(0, n - 1)].decode("latin-1", "ignore") or None


def credential_hints(data: bytes, packet: str | None, scan: int | None = SCAN) -> list[str]:
    """Terms of content credentials in the first bytes (all of them with no bound), and in XMP."""
    head = data[:scan].lower()
    hits = [t.decode() for t in CREDENTIAL_TERMS if t in head]
    return hits + ["xmp:c2pa"] * bool(packet and re.search(r"(?i)\bc2pa\b", packet))


def image_format(data: bytes) -> str:
    for start, name in ((b"\xff\xd8", "JPEG"), (b"\x89PNG", "PNG"), (b"GIF8", "GIF"), (b"BM", "BMP"), (b"II*\0", "TIFF"), (b"MM\0*", "TIFF")):
        if data.startswith(start):
            return name
    return "WEBP" if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else "unknown"


def png(pixels: np.ndarray) -> bytes:
    """A PNG of grey (h x w) or RGB (h x w x 3) bytes."""
    h, w = pixels.shape[:2]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.pad(pixels.reshape(h, -1), ((0, 0), (1, 0))).astype(np.uint8)
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")
