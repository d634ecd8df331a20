"""Images larger than a task: overlapping tiles that tasks share out, and cells that put them together.

``cut`` reads an image once and hands it on tile by tile; after it no row holds a
whole image. A tile is a cell of a grid with a halo around it, so that a filter
sees what it reaches. Tiles are filtered in whatever tasks they fall to. Where
filtered tiles overlap, by ``shared`` pixels beyond their cells, each cell gets
the parts that its neighbours have of it, and a pixel is their sum over their
count. An image beyond ``limit`` is filtered smaller, by area means, and what
comes out is enlarged again, cell by cell, by linear interpolation.

Statistics of an image's residual are merged from moments of its cells; the
percentile is exact: counts by leading bits of the values find the narrow range
that holds its rank, and only values of that range are ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import image_kernels as kernels
from ..session import Tables

CUT = "status string, error string, height int, width int, h int, w int, y int, x int, top int, left int, rows int, columns int, plane binary, own binary"
PART = "height int, width int, h int, w int, y int, x int, top int, left int, rows int, columns int, part binary, own binary"
CELL = "n long, mean double, m2 double, m3 double, m4 double, abs_mean double, abs_m2 double, energy double, residual binary"
#: Leading bits of a double that stay in a range's number: sign, exponent and eight of the mantissa.
SHIFT = 44
#: Bytes of a batch that leaves a task, at least.
BATCH = 4 << 20
AT = 0.95


def scaled_size(height: int, width: int, limit: int | None) -> tuple[int, int]:
    """The size at which an image is filtered."""
    if limit is None or max(height, width) <= limit:
        return height, width
    scale = min(limit / height, limit / width)
    return max(1, int(height * scale)), max(1, int(width * scale))


def spans(size: int, side: int, halo: int) -> list[tuple[int, int, int, int]]:
    """Start and end of each cell along one axis, and of its tile; one for all if a tile holds the axis."""
    step = side - 2 * halo
    if step < 1:
        raise ValueError("the halo leaves nothing of a tile")
    if size <= side:
        return [(0, size, 0, size)]
    return [(a, min(size, a + step), max(0, a - halo), min(size, a + step + halo)) for a in range(0, size, step)]


def first_of(start: int, scaled: int, size: int) -> int:
    """The first pixel of the whole axis that belongs to a cell which starts there on the scaled one."""
    return -(-start * size // scaled)


def _mapped(df: DataFrame, keys: list[str], schema: str, work: Callable[[dict], Iterator[dict]], same: list[str] | None = None) -> DataFrame:
    """What ``work`` yields of each row with the row's keys, in batches of bounded bytes.

    With ``same``, rows come sorted by those columns, and ``work`` gets the list
    of all rows that agree in them.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), schema])
    form = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[dict | list[dict]]:
        group: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if not same:
                    yield row
                elif group and any(row[c] != group[0][c] for c in same):
                    yield group
                    group = [row]
                else:
                    group.append(row)
        if group:
            yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for item in grouped(batches):
            own = {k: (item[0] if same else item)[k] for k in keys}
            for found in work(item):
                out.append(own | found)
                size += 64 + sum(len(v) if isinstance(v, bytes) else v.nbytes for v in found.values() if isinstance(v, bytes | np.ndarray))
                if size >= BATCH:
                    yield pa.RecordBatch.from_pylist(out, form)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, form)

    return df.mapInArrow(run, schema)


def cut(pixels: DataFrame, keys: list[str], side: int, halo: int, limit: int | None = None) -> DataFrame:
    """A row for each tile of each image: its place, its pixels at the scaled size, and its cell's own pixels if those differ.

    An image without pixels, or whose pixels are not of its size, is one row with
    status error.
    """
    spans(1, side, halo)
    names = [f.split()[0] for f in CUT.split(", ")]

    def work(row: dict) -> Iterator[dict]:
        try:
            if row["rgb"] is None:
                raise ValueError("the image has no pixels")
            height, width = int(row["height"]), int(row["width"])
            grey = kernels.grey(np.frombuffer(row["rgb"], np.uint8).reshape(height, width, 3))
            if not grey.size:
                raise ValueError("the image has no pixels")
        except (ValueError, TypeError) as failure:
            yield dict.fromkeys(names) | {"status": "error", "error": str(failure)}
            return
        h, w = scaled_size(height, width, limit)
        small = grey if (h, w) == (height, width) else np.rint(kernels.area_scaled(grey, h, w)).astype(np.uint8)
        for y, y_end, top, bottom in spans(h, side, halo):
            for x, x_end, left, right in spans(w, side, halo):
                own = None
                if small is not grey:
                    own = grey[first_of(y, h, height) : first_of(y_end, h, height), first_of(x, w, width) : first_of(x_end, w, width)].tobytes()
                yield {
                    "status": "completed", "error": None, "height": height, "width": width, "h": h, "w": w, "y": y, "x": x, "top": top, "left": left,
                    "rows": bottom - top, "columns": right - left, "plane": small[top:bottom, left:right].tobytes(), "own": own,
                }

    return _mapped(pixels.select(*keys, "height", "width", "rgb"), keys, CUT, work)


def filtered(tiles: DataFrame, keys: list[str], denoise: Callable[[np.ndarray], np.ndarray], side: int, halo: int, shared: int = 0) -> DataFrame:
    """Parts of filtered tiles by the cell (y, x) that they belong to, with the cell's own pixels in one of them.

    A tile gives its neighbours what lies within ``shared`` pixels of its cell,
    and a pixel more of each side where cells are enlarged afterwards.
    """
    if not 0 <= shared <= halo:
        raise ValueError("tiles share no more than their halo")

    def work(row: dict) -> Iterator[dict]:
        h, w, y, x, top, left = (int(row[c]) for c in ("h", "w", "y", "x", "top", "left"))
        plane = np.frombuffer(row["plane"], np.uint8).reshape(int(row["rows"]), int(row["columns"]))
        out = np.asarray(denoise(plane), np.float64)
        wide = int((h, w) != (row["height"], row["width"]))
        rows, columns = spans(h, side, halo), spans(w, side, halo)
        y_end, x_end = (next(b for a, b, *_ in axis if a == start) for axis, start in ((rows, y), (columns, x)))
        for a, a_end in ((a, b) for a, b, *_ in rows if a - wide < y_end + shared and b + wide > y - shared):
            for b, b_end in ((a, b) for a, b, *_ in columns if a - wide < x_end + shared and b + wide > x - shared):
                mine, own = (a, b) == (y, x), None
                if mine:
                    own = row["own"] if wide else plane[y - top : y_end - top, x - left : x_end - left].tobytes()
                r0, r1 = max(a - wide, y - shared, top), min(a_end + wide, y_end + shared, top + len(plane))
                c0, c1 = max(b - wide, x - shared, left), min(b_end + wide, x_end + shared, left + plane.shape[1])
                if r0 < r1 and c0 < c1:
                    part = np.ascontiguousarray(out[r0 - top : r1 - top, c0 - left : c1 - left]).tobytes()
                    yield {"height": row["height"], "width": row["width"], "h": h, "w": w, "y": a, "x": b, "top": r0, "left": c0, "rows": r1 - r0, "columns": c1 - c0, "part": part, "own": own}

    return _mapped(dealt(tiles, keys), keys, PART, work)


def dealt(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles shared out among tasks, so that an image is filtered by many."""
    return tiles.filter("status = 'completed'").repartition(*keys, "y", "x")


def alone(tiles: DataFrame, keys: list[str], denoise: Callable[[np.ndarray], np.ndarray], side: int, halo: int) -> DataFrame:
    """``cells`` of tiles that share nothing and keep their size: each tile is its cell's, and no part travels."""

    def work(row: dict) -> Iterator[dict]:
        h, w, y, x, top, left = (int(row[c]) for c in ("h", "w", "y", "x", "top", "left"))
        plane = np.frombuffer(row["plane"], np.uint8).reshape(int(row["rows"]), int(row["columns"]))
        y_end, x_end = (next(b for a, b, *_ in spans(n, side, halo) if a == start) for n, start in ((h, y), (w, x)))
        residual = plane.astype(np.float64) - np.asarray(denoise(plane), np.float64)
        yield {"y": y, "x": x, **moments(residual[y - top : y_end - top, x - left : x_end - left])}

    return _mapped(dealt(tiles, keys), keys, f"y int, x int, {CELL}", work)


def joined_cell(parts: list[dict], side: int, halo: int) -> tuple[np.ndarray, np.ndarray]:
    """A cell's own pixels and what the filter makes of them, from all parts of it."""
    one = parts[0]
    height, width, h, w, y, x = (int(one[c]) for c in ("height", "width", "h", "w", "y", "x"))
    wide = int((h, w) != (height, width))
    y_end = next(b for a, b, *_ in spans(h, side, halo) if a == y)
    x_end = next(b for a, b, *_ in spans(w, side, halo) if a == x)
    top, left, bottom, right = max(0, y - wide), max(0, x - wide), min(h, y_end + wide), min(w, x_end + wide)
    total, count = np.zeros((bottom - top, right - left)), np.zeros((bottom - top, right - left))
    for p in parts:
        r, c, rows, columns = (int(p[n]) for n in ("top", "left", "rows", "columns"))
        area = np.s_[r - top : r - top + rows, c - left : c - left + columns]
        total[area] += np.frombuffer(p["part"]).reshape(rows, columns)
        count[area] += 1
    denoised = total / np.maximum(count, 1)
    if wide:
        rows, columns = (np.arange(first_of(a, s, n), first_of(b, s, n)) for a, b, s, n in ((y, y_end, h, height), (x, x_end, w, width)))
        denoised = kernels.linear_scaled(denoised, rows, columns, (h, w), (height, width), (top, left))
    own = next(p["own"] for p in parts if p["own"] is not None)
    return np.frombuffer(own, np.uint8).reshape(denoised.shape).astype(np.float64), denoised


def moments(residual: np.ndarray) -> dict:
    """What of a cell's residual adds up: its size, means and sums of powers around them."""
    r, size = residual.ravel(), np.abs(residual).ravel()
    d = r - r.mean()
    return {
        "n": len(r), "mean": float(r.mean()), "m2": float((d**2).sum()), "m3": float((d**3).sum()), "m4": float((d**4).sum()), "abs_mean": float(size.mean()),
        "abs_m2": float(((size - size.mean()) ** 2).sum()), "energy": float((r**2).sum()), "residual": r.tobytes(),
    }


def cells(parts: DataFrame, keys: list[str], side: int, halo: int) -> DataFrame:
    """y, x and moments of every cell; its parts, at most those of its neighbours, are read together."""

    def work(rows: list[dict]) -> Iterator[dict]:
        own, denoised = joined_cell(rows, side, halo)
        yield {"y": rows[0]["y"], "x": rows[0]["x"], **moments(own - denoised)}

    by = [*keys, "y", "x"]
    return _mapped(parts.repartition(*by).sortWithinPartitions(*by), keys, f"y int, x int, {CELL}", work, by)


def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of each image from those of its cells, by the formulas for means that move."""
    n = F.sum("n").alias("all_n")
    means = rows.groupBy(*keys).agg(n, (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all_mean"), (F.sum(F.col("n") * F.col("abs_mean")) / F.sum("n")).alias("all_abs"))
    both = matched(rows, means, keys)
    d, a, n = F.col("mean") - F.col("all_mean"), F.col("abs_mean") - F.col("all_abs"), F.col("n")
    sums = {
        "m2": F.col("m2") + n * d**2,
        "m3": F.col("m3") + 3 * d * F.col("m2") + n * d**3,
        "m4": F.col("m4") + 4 * d * F.col("m3") + 6 * d**2 * F.col("m2") + n * d**4,
        "abs_m2": F.col("abs_m2") + n * a**2,
        "energy": F.col("energy"),
    }
    out = both.groupBy(*keys).agg(*(F.any_value(c).alias(c) for c in ("all_n", "all_mean", "all_abs")), *(F.sum(e).alias(f"s_{c}") for c, e in sums.items()))
    std = F.sqrt(F.col("s_m2") / F.col("all_n"))
    spread = std > 0
    return out.select(
        *keys, F.col("all_n").alias("n"), F.col("all_mean").alias("mean"), std.alias("std"),
        F.when(spread, F.col("s_m3") / F.col("all_n") / std**3).otherwise(0.0).alias("skew"),
        F.when(spread, F.col("s_m4") / F.col("all_n") / std**4 - 3).otherwise(0.0).alias("kurtosis"),
        (F.col("s_energy") / F.col("all_n")).alias("energy"), F.col("all_abs").alias("abs_mean"), F.sqrt(F.col("s_abs_m2") / F.col("all_n")).alias("abs_std"),
    )


def matched(rows: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of their keys' row; nulls are keys too."""
    named = one.select(*(F.col(k).alias(f"{k}__") for k in keys), *(c for c in one.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same &= rows[k].eqNullSafe(named[f"{k}__"])
    return rows.join(named, same).drop(*(f"{k}__" for k in keys))


def percentile(rows: DataFrame, keys: list[str], at: float = AT) -> DataFrame:
    """The percentile of residual sizes over all cells of an image, linear between its two neighbours in order."""

    def ranges(row: dict) -> tuple[np.ndarray, np.ndarray]:
        size = np.abs(np.frombuffer(row["residual"]))
        return size, size.view(np.int64) >> SHIFT

    def counted(row: dict) -> Iterator[dict]:
        own, n = np.unique(ranges(row)[1], return_counts=True)
        yield {"part": own, "k": n}

    def chosen(row: dict) -> Iterator[dict]:
        size, part = ranges(row)
        own, n = np.unique(size[(part == row["low"]) | (part == row["high"])], return_counts=True)
        yield from ({"v": a, "k": b, "low_rank": row["low_rank"], "frac": row["frac"], "before": row["before"]} for a, b in zip(own.tolist(), n.tolist(), strict=True))

    by = Window.partitionBy(*keys)
    # a row a cell leaves Python, and its ranges become rows in Spark
    parts = _mapped(rows.select(*keys, "residual"), keys, "part array<long>, k array<long>", counted)
    parts = parts.select(*keys, F.inline(F.arrays_zip("part", "k"))).groupBy(*keys, "part").agg(F.sum("k").alias("k"))
    upto = F.sum("k").over(by.orderBy("part"))
    parts = parts.withColumns({"upto": upto, "n": F.sum("k").over(by)}).withColumn("pos", F.lit(at) * (F.col("n") - 1))
    low = F.floor("pos")
    high = F.least(low + 1, F.col("n") - 1)
    parts = parts.withColumns({"low_rank": low, "frac": F.col("pos") - low, "first": F.col("upto") - F.col("k")})
    held = parts.groupBy(*keys).agg(
        F.min(F.when(F.col("upto") > low, F.col("part"))).alias("low"), F.min(F.when(F.col("upto") > high, F.col("part"))).alias("high"),
        F.min(F.when(F.col("upto") > low, F.col("first"))).alias("before"), F.any_value("low_rank").alias("low_rank"), F.any_value("frac").alias("frac"),
    )
    values = _mapped(matched(rows.select(*keys, "residual"), held, keys), keys, "v double, k long, low_rank long, frac double, before long", chosen)
    values = values.groupBy(*keys, "v").agg(F.sum("k").alias("k"), *(F.any_value(c).alias(c) for c in ("low_rank", "frac", "before")))
    values = values.withColumn("upto", F.col("before") + F.sum("k").over(by.orderBy("v")))
    lower, upper = F.min(F.when(F.col("upto") > F.col("low_rank"), F.col("v"))), F.min(F.when(F.col("upto") > F.col("low_rank") + 1, F.col("v")))
    return values.groupBy(*keys).agg((lower + F.any_value("frac") * (F.coalesce(upper, lower) - lower)).alias("abs_p95"))


def tiled_residuals(pixels: DataFrame, keys: list[str], denoise: Callable[[np.ndarray], np.ndarray] = kernels.smoothed, side: int = 1024, halo: int = 64, shared: int = 0, limit: int | None = None) -> DataFrame:
    """``images.residuals`` for images of any size: keys, status, error, n, the moments of the residual and its percentile.

    The keys name an image. A local filter that reaches no further than the halo
    less ``shared`` gives what it gives on the whole image. Rows whose image
    can't be read stay, with status error; an empty table gives no rows.
    """
    tables = Tables(pixels.sparkSession)
    tiles = tables.keep("tiles", cut(pixels, keys, side, halo, limit))
    if shared or limit is not None:
        found = cells(filtered(tiles, keys, denoise, side, halo, shared), keys, side, halo)
    else:
        found = alone(tiles, keys, denoise, side, halo)
    found = tables.keep("cells", found)
    good = matched(merged(found, keys), percentile(found, keys), keys)
    bad = tiles.filter("status <> 'completed'").select(*keys, "status", "error")
    return good.withColumns({"status": F.lit("completed"), "error": F.lit(None).cast("string")}).unionByName(bad, allowMissingColumns=True)
