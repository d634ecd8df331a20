"""Image operators: Arrow batches of files or pixels through the array kernels.

Pixels are rows of (height, width, rgb bytes), as ``sources.readers.read_pixels``
gives them. A file or image that can't be read has status error and nulls; its
row stays.

``read`` makes the RGB bytes of what rgb holds (a file's bytes, say), image by
image inside the task, so that pixels neither travel between Spark and Python
nor stand by in batches. Arrow batches hold are worked on and handed on WORK rows at a time.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import image_bytes as files
from ..functions import image_kernels as kernels

METADATA = "status string, error string, format string, bytes long, exif map<string,string>, tag_count int, xmp string, icc_bytes int, icc_description string, credential_hints array<string>"
TABLES = "status string, error string, luma array<int>, quality int, quality_error double, exact boolean"
SPECTRUM = "status string, error string, dct_mean double, dct_std double, radial_mean double, radial_std double, decay double, decay_r2 double, low double, mid double, high double, peakiness double"
BLOCKS = "status string, error string, sac double, primary array<int>, unclipped array<boolean>, tamper array<double>, periods array<int>, block_rows int, block_columns int"
LEVELS = "status string, error string, ela_mean double, ela_std double, ela_anomaly double, ela_map string"
RESIDUALS = "status string, error string, mean double, std double, skew double, kurtosis double, energy double, abs_mean double, abs_std double, abs_p95 double"


#: Rows of a batch that are worked on, and whose results leave a task, at once.
WORK = 256
#: Pixels of the windows that are worked on side by side, unless one has more.
BESIDE = 1 << 14
#: What makes an image's row one of status error.
FAILURES = (ValueError, TypeError, IndexError, KeyError, ArithmeticError, struct.error)
Read = Callable[[object], bytes | None]


@F.pandas_udf(T.BinaryType())
def rgb_bytes(channels: pd.Series, data: pd.Series) -> pd.Series:
    """RGB bytes of the image source's pixels, which are blue first, with or without alpha, or grey."""

    def one(n: int, raw: bytes) -> bytes | None:
        if n < 1:
            return None
        x = np.frombuffer(raw, np.uint8).reshape(-1, n)
        return (np.repeat(x, 3, axis=1) if n == 1 else x[:, 2::-1]).tobytes()

    return pd.Series([one(n, raw) for n, raw in zip(channels, data, strict=True)])


def _mapped(df: DataFrame, keys: list[str], inputs: list[str], schema: str, kernel) -> DataFrame:  # noqa: ANN001
    """Keys and what the kernel finds of each row; an exception becomes the row's error."""
    kinds = dict(df.dtypes)
    names = [part.strip().split(" ")[0] for part in _fields(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _few(batches):
            rows = [_tried(kernel, values) for values in zip(*(batch[c] for c in inputs), strict=True)]
            found = pd.DataFrame({n: pd.Series([r.get(n) for r in rows], index=batch.index, dtype=object) for n in names})
            yield pd.concat([batch[keys], found], axis=1)

    out = ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema])
    return df.select(*dict.fromkeys([*keys, *inputs])).mapInPandas(run, out)


def _few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i in range(0, len(batch), WORK):
            yield batch.iloc[i : i + WORK]


def _tried(kernel: Callable, values: tuple) -> dict:
    try:
        return {"status": "completed", "error": None, **kernel(*values)}
    except FAILURES as failure:
        return {"status": "error", "error": str(failure)}


def _fields(schema: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[last:i])
            last = i + 1
    return [*out, schema[last:]]


def _plane(height: int, width: int, rgb: object, read: Read | None = None) -> np.ndarray:
    if rgb is not None and read:
        rgb = read(rgb)
    if rgb is None:
        raise ValueError("the image has no pixels")
    return np.frombuffer(rgb, np.uint8).reshape(height, width, 3)


def metadata(
    df: DataFrame, keys: list[str], content: str = "content", scan: int | None = files.SCAN, most_tags: int | None = files.MOST_TAGS, window: int | None = files.XMP_WINDOW
) -> DataFrame:
    """EXIF, XMP, colour profile, file facts and hints of content credentials of files.

    ``scan`` bounds the bytes that are searched for XMP outside its segment and
    for credential terms, ``most_tags`` the tags, ``window`` an XMP packet without
    an end; None lifts a bound.
    """

    def kernel(data: bytes) -> dict:
        found, packet = files.exif(data, most_tags), files.xmp(data, scan, window)
        size, description = files.icc(data)
        return {
            "format": files.image_format(data), "bytes": len(data), "exif": {k: v if isinstance(v, str) else json.dumps(v) for k, v in found.items()},
            "tag_count": len(found), "xmp": packet, "icc_bytes": size, "icc_description": description, "credential_hints": files.credential_hints(data, packet, scan),
        }

    return _mapped(df, keys, [content], METADATA, kernel)


def quantisation(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """The luma table of JPEG files and the quality nearest to it."""

    def kernel(data: bytes) -> dict:
        table = files.quantisation_tables(data).get(0)
        if table is None:
            raise ValueError("no quantisation table")
        quality, error = kernels.quality_of(np.array(table).reshape(8, 8))
        return {"luma": table, "quality": quality, "quality_error": error, "exact": error == 0}

    return _mapped(df, keys, [content], TABLES, kernel)


def block_analysis(pixels: DataFrame, keys: list[str], read: Read | None = None) -> DataFrame:
    """Block statistics of pixels: rise of the factor histogram, primary table, unclipped blocks and the map of changed ones."""

    def kernel(height: int, width: int, rgb: bytes) -> dict:
        g = kernels.grey(_plane(height, width, rgb, read))
        dct, keep = kernels.block_dct(g), kernels.unclipped(g)
        if not dct.size:
            raise ValueError("the image is too small for a block")
        likely, periods = kernels.tamper_map(dct)
        return {
            "sac": kernels.sac(dct), "primary": kernels.primary_table(dct, keep).ravel().tolist(), "unclipped": keep.ravel().tolist(),
            "tamper": likely.ravel().tolist(), "periods": periods, "block_rows": dct.shape[0], "block_columns": dct.shape[1],
        }

    return _mapped(pixels, keys, ["height", "width", "rgb"], BLOCKS, kernel)


def raw_blocks(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Statistics of the coefficients that baseline JPEG files store: the rise of the factor histogram and the map of changed blocks, of luma."""
    from ..functions.baseline_jpeg import coefficients

    def kernel(data: bytes) -> dict:
        parts, tables = coefficients(data)
        likely, periods = kernels.tamper_map(parts[0] * tables[0])
        sac = kernels.sac(parts[0].astype(float))
        return {"sac": sac, "luma": tables[0].ravel().tolist(), "quality": kernels.quality_of(tables[0])[0], "tamper": likely.ravel().tolist(), "periods": periods, "block_rows": likely.shape[0], "block_columns": likely.shape[1]}

    schema = "status string, error string, sac double, luma array<int>, quality int, tamper array<double>, periods array<int>, block_rows int, block_columns int"
    return _mapped(df, keys, [content], schema, kernel)


def frequency(pixels: DataFrame, keys: list[str], read: Read | None = None) -> DataFrame:
    return _mapped(pixels, keys, ["height", "width", "rgb"], SPECTRUM, lambda h, w, rgb: kernels.spectrum_features(kernels.grey(_plane(h, w, rgb, read))))


def error_level(pixels: DataFrame, keys: list[str], quality: int = 75, scale: float = 50, contrast: float = 20, linear: bool = False, want_map: bool = False, read: Read | None = None) -> DataFrame:
    """Error-level statistics, and the map as PNG in base64 if wanted."""

    def kernel(h: int, w: int, rgb: bytes) -> dict:
        levels = kernels.error_levels(_plane(h, w, rgb, read), quality, scale, contrast, linear)
        mean, std, anomaly = kernels.error_level_stats(levels)
        return {"ela_mean": mean, "ela_std": std, "ela_anomaly": anomaly, "ela_map": base64.b64encode(files.png(levels)).decode() if want_map else None}

    return _mapped(pixels, keys, ["height", "width", "rgb"], LEVELS, kernel)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def network_input(height: pd.Series, width: pd.Series, rgb: pd.Series) -> pd.Series:
    """Pixels as a network reads them: values over 256, channel by channel; null for an image without pixels."""
    return pd.Series([None if raw is None else (_plane(h, w, raw).transpose(2, 0, 1).ravel() / np.float32(256)).astype(np.float32) for h, w, raw in zip(height, width, rgb, strict=True)])


@F.pandas_udf(T.StringType())
def map_png(height: pd.Series, width: pd.Series, values: pd.Series) -> pd.Series:
    """A map of values from 0 to 1, by rows, as a grey PNG in base64; values beyond are clipped, null for a map of another size."""

    def one(h: int, w: int, x) -> str | None:  # noqa: ANN001
        if x is None or len(x) != h * w:
            return None
        grey = (np.clip(np.nan_to_num(np.asarray(x, np.float64)), 0, 1) * 255).astype(np.uint8).reshape(h, w)
        return base64.b64encode(files.png(np.repeat(grey[..., None], 3, axis=2))).decode()

    return pd.Series([one(h, w, x) for h, w, x in zip(height, width, values, strict=True)])


def residuals(pixels: DataFrame, keys: list[str], denoise=kernels.smoothed, read: Read | None = None) -> DataFrame:  # noqa: ANN001
    """Moments of the denoising residual; the denoiser is a function of a grey plane."""
    return _mapped(pixels, keys, ["height", "width", "rgb"], RESIDUALS, lambda h, w, rgb: kernels.residual_stats(kernels.grey(_plane(h, w, rgb, read)), denoise))


def windowed(pixels: DataFrame, keys: list[str], window: int = 256, read: Read | None = None) -> DataFrame:
    """A row for each half-overlapping window of an image, with its pixels; a smaller image is one window.

    Each image is handed to Python once and read window by window, so what moves
    is the image and its windows, whatever their number.
    """
    kinds, stride = dict(pixels.dtypes), max(1, window // 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                own, raw = {k: row[k] for k in keys}, row["rgb"]
                if raw is not None and read:
                    raw = read(raw)
                if raw is None:
                    yield pd.DataFrame([own | {"y": 0, "x": 0, "win_h": None, "win_w": None, "win": None}], dtype=object)
                    continue
                h, w = int(row["height"]), int(row["width"])
                if window > h or window > w:
                    yield pd.DataFrame([own | {"y": 0, "x": 0, "win_h": h, "win_w": w, "win": raw}], dtype=object)
                    continue
                plane = _plane(h, w, raw)
                for y in range(0, h - window + 1, stride):
                    line = [own | {"y": y, "x": x, "win_h": window, "win_w": window, "win": plane[y : y + window, x : x + window].tobytes()} for x in range(0, w - window + 1, stride)]
                    yield pd.DataFrame(line, dtype=object)

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "y int, x int, win_h int, win_w int, win binary"])
    return pixels.select(*keys, "height", "width", "rgb").mapInPandas(run, schema)


def pattern_windows(pixels: DataFrame, keys: list[str], window: int = 256, pattern: str = "RGGB", rounds: int = 50, read: Read | None = None) -> DataFrame:
    """Per window, as ``windowed`` has them, and channel the measure of the filter pattern, and the texture of green.

    Windows are cut inside the task; those of one size are worked on side by side,
    also of several images, up to BESIDE pixels of them.
    """
    kinds = dict(pixels.dtypes)
    values = ("m_r", "m_g", "m_b", "texture")

    def cut(row: dict) -> list[tuple[dict, np.ndarray | str]]:
        """Each window's columns and its pixels, or the error of an image that can't be read."""
        own = {k: row[k] for k in keys} | {"y": 0, "x": 0, "win_h": None, "win_w": None}
        try:
            if row["rgb"] is None:
                raise ValueError("the image has no pixels")
            h, w = int(row["height"]), int(row["width"])
            high, wide = (h, w) if window > h or window > w else (window, window)
            own |= {"win_h": high, "win_w": wide}
            plane, stride = _plane(h, w, row["rgb"], read), max(1, window // 2)
            return [(own | {"y": y, "x": x}, plane[y : y + high, x : x + wide]) for y in range(0, h - high + 1, stride) for x in range(0, w - wide + 1, stride)]
        except FAILURES as failure:
            return [(own, str(failure))]

    def measured(windows: list[tuple[dict, np.ndarray]]) -> list[dict]:
        """Rows of windows of one size."""
        try:
            x = np.stack([plane for _, plane in windows]).transpose(0, 3, 1, 2) / 255.0
            found = kernels.pattern_measures(x.reshape(-1, *x.shape[2:]), "RGB" * len(x), pattern, rounds=rounds).reshape(-1, 3)
            rows = zip(windows, found.tolist(), x[:, 1].var((1, 2)).tolist(), strict=True)
            return [own | {"status": "completed", "error": None} | dict(zip(values, [*m, texture], strict=True)) for (own, _), m, texture in rows]
        except FAILURES as failure:
            if len(windows) > 1:
                return [row for one in windows for row in measured([one])]
            return [windows[0][0] | {"status": "error", "error": str(failure)}]

    def rows(batch: pd.DataFrame) -> Iterator[dict]:
        waiting: list[tuple[dict, np.ndarray]] = []
        for row in batch.to_dict("records"):
            for own, plane in cut(row):
                if isinstance(plane, str):
                    yield own | {"status": "error", "error": plane}
                    continue
                if waiting and (waiting[0][1].shape != plane.shape or len(waiting) * plane.size > 3 * BESIDE - plane.size):
                    yield from measured(waiting)
                    waiting = []
                waiting.append((own, plane))
        if waiting:
            yield from measured(waiting)

    names = [*keys, "y", "x", "win_h", "win_w", "status", "error", *values]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _few(batches):
            found = rows(batch)
            while some := list(islice(found, WORK)):
                yield pd.DataFrame({n: pd.Series([r.get(n) for r in some], dtype=object) for n in names})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "y int, x int, win_h int, win_w int, status string, error string", *(f"{c} double" for c in values)])
    return pixels.select(*keys, "height", "width", "rgb").mapInPandas(run, schema)


def report(df: DataFrame) -> Column:
    """A file's authentication report as Markdown lines, from its metadata and table columns."""
    from ..functions.text import checkbox, compression_bucket, format_bytes

    state = compression_bucket(F.col("format"))
    lines = [
        F.lit("# Image authentication report"),
        F.concat(F.lit("- Format: "), F.coalesce("format", F.lit("unknown"))),
        F.concat(F.lit("- Size: "), format_bytes(F.col("bytes"))),
        F.concat(F.lit("- Compression artifacts: "), checkbox(state == "present"), F.lit(" present "), checkbox(state == "not_present"), F.lit(" not present")),
        F.concat(F.lit("- EXIF tags: "), F.coalesce(F.col("tag_count").cast("string"), F.lit("0"))),
        F.concat(F.lit("- Content credentials: "), checkbox(F.size("credential_hints") > 0)),
    ]
    return F.concat_ws("\n", *lines)
