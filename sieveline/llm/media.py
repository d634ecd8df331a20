"""Media columns: texts stored in progressive JPEG, and images read as RGB tensors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from .text import blocks, tidy

UNIT = 64


def padded(data: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of UNIT."""
    return data + bytes(UNIT - len(data) if not data else -len(data) % UNIT)


def batched(column: pa.Array, size: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
    """Values of a binary column in runs of about ``size`` bytes, with the first one's place."""
    at, run, held = 0, [], 0
    for i, value in enumerate(column):
        raw = value.as_py() or b""
        if run and held + len(raw) > size:
            yield at, run
            at, run, held = i, [], 0
        run.append(raw)
        held += len(raw)
    if run:
        yield at, run


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (a progressive JPEG) of every row.

    A null text counts as empty and is one block of zeros. Equal texts are equal
    files. A text of any length is one file. Extra columns are left out; an
    empty table gives no rows.
    """
    kind = dict(docs.dtypes)["doc_id"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), 1 << 21):
                raw = [block.bytes_of(i) for i in range(len(block))]
                files = jpeg.encode([padded(r) for r in raw])
                key = batch.column("doc_id")[block.first : block.first + len(block)]
                yield pa.RecordBatch.from_arrays([key, pa.array([len(r) for r in raw], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def _each(media: DataFrame, columns: list[str], row, schema: str, types: list[pa.DataType]) -> DataFrame:
    """The named columns and what ``row`` makes of each file's bytes, header, coefficients and tensor."""
    kept = [f"`{n}` {t}" for n, t in media.dtypes if n in columns]
    names = [part.split()[0] for part in schema.split(", ")]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raws in batched(batch.column("media")):
                rows = [row(*x) for x in zip(raws, *jpeg.decode(raws), strict=True)]
                own = [batch.column(c)[first : first + len(raws)] for c in columns]
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*own, *made], [*columns, *names])

    return media.select(*columns, "media").mapInArrow(run, ", ".join([*kept, schema]))


def digest(media: DataFrame) -> DataFrame:
    """What is read back from stored texts: digests of the payload and the file, and features of the image."""

    def row(raw: bytes, f: jpeg.File, table: np.ndarray, rgb: np.ndarray) -> tuple:
        data = jpeg.payload(f, table)
        means = rgb.reshape(-1, 3).sum(0, dtype=np.int64) / (rgb.shape[0] * rgb.shape[1])
        feature = f"{rgb.shape[1]}x{rgb.shape[0]} rgb {means[0]:.3f} {means[1]:.3f} {means[2]:.3f} crc32 {zlib.crc32(rgb.tobytes()):08x}"
        sha = hashlib.sha256
        return len(data), sha(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(raw), sha(raw).hexdigest(), feature

    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _each(media, ["doc_id", "n_bytes"], row, schema, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])


def texts(media: DataFrame) -> DataFrame:
    """doc_id and text of stored texts."""
    found = _each(media, ["doc_id", "n_bytes"], lambda raw, f, table, rgb: (jpeg.payload(f, table),), "payload binary", [pa.binary()])
    return found.selectExpr("doc_id", "decode(substring(payload, 1, CAST(n_bytes AS INT)), 'UTF-8') AS text")


def tensors(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, height, width and rgb (height x width x 3 bytes) of progressive JPEG files, at full resolution."""

    def row(raw: bytes, f: jpeg.File, table: np.ndarray, rgb: np.ndarray) -> tuple:
        return rgb.shape[0], rgb.shape[1], rgb.tobytes()

    return _each(media, [key], row, "height int, width int, rgb binary", [pa.int32(), pa.int32(), pa.binary()])
