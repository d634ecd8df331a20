import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions import image_kernels as kernels
from sieveline.operators import images, tiles


def picture(seed, h, w):
    rng = np.random.default_rng(seed)
    base = np.clip(np.cumsum(rng.normal(0, 6, (h, w)), 1) + 120 + rng.normal(0, 5, (h, w)), 0, 255)
    return np.repeat(base.astype(np.uint8)[..., None], 3, 2)


def frame(spark, images_):
    rows = [(k, None if x is None else x.shape[0], None if x is None else x.shape[1], None if x is None else x.tobytes(), "mean") for k, x in images_.items()]
    return spark.createDataFrame(rows, "name string, height int, width int, rgb binary, mean string")


def whole(plane, denoise, limit=None):
    """The filter over a whole plane, smaller if need be."""
    h, w = tiles.scaled_size(*plane.shape, limit)
    if (h, w) == plane.shape:
        return denoise(plane)
    small = denoise(np.rint(kernels.area_scaled(plane, h, w)).astype(np.uint8))
    return kernels.linear_scaled(small, np.arange(plane.shape[0]), np.arange(plane.shape[1]), (h, w), plane.shape)


NAMES = ("mean", "std", "skew", "kurtosis", "energy", "abs_mean", "abs_std", "abs_p95")
PICTURES = {"wide": picture(1, 61, 170), "tall": picture(2, 133, 40), "tile": picture(3, 40, 40), "next": picture(4, 41, 73), "dot": picture(5, 1, 1), "line": picture(6, 1, 200), "flat": np.full((90, 50, 3), 7, np.uint8), "none": None}


@pytest.mark.parametrize("side, halo, shared, limit", [(40, 6, 0, None), (40, 6, 3, None), (17, 5, 1, None), (40, 6, 3, 100), (24, 4, 0, 37), (1024, 64, 0, None)])
def test_tiles_match_the_whole_image(spark, side, halo, shared, limit):
    found = {r.name: r for r in tiles.tiled_residuals(frame(spark, PICTURES), ["name"], side=side, halo=halo, shared=shared, limit=limit).collect()}
    assert set(found) == set(PICTURES)
    assert found["none"].status == "error" and found["none"].error and found["none"].mean is None
    for name, x in PICTURES.items():
        if x is None:
            continue
        grey = kernels.grey(x)
        want = kernels.residual_stats(grey, lambda p: whole(p, kernels.smoothed, limit))
        assert found[name].status == "completed" and found[name].n == grey.size
        flat = want["std"] < 1e-9
        for c in NAMES:
            if not (flat and c in ("skew", "kurtosis")):  # of rounding alone
                assert abs(found[name][c] - want[c]) < 1e-8 * max(1, abs(want[c])), (name, c)


@pytest.mark.parametrize("side, halo, shared, limit", [(40, 6, 3, None), (24, 4, 1, 60)])
def test_every_pixel_is_that_of_the_whole_image(spark, side, halo, shared, limit):
    cut = tiles.cut(frame(spark, PICTURES), ["name"], side, halo, limit)
    biggest = cut.agg(F.max(F.length("plane"))).first()[0]
    assert biggest <= side * side
    parts = [r.asDict() for r in tiles.filtered(cut, ["name"], kernels.smoothed, side, halo, shared).collect()]
    groups = {}
    for p in parts:
        groups.setdefault((p["name"], p["y"], p["x"]), []).append(p)
    for name, x in PICTURES.items():
        if x is None:
            continue
        grey = kernels.grey(x)
        want = whole(grey, kernels.smoothed, limit)
        h, w = tiles.scaled_size(*grey.shape, limit)
        seen = np.zeros(grey.shape, int)
        for (n, y, x0), own in groups.items():
            if n == name:
                pixels, denoised = tiles.joined_cell(own, side, halo)
                a, b = tiles.first_of(y, h, grey.shape[0]), tiles.first_of(x0, w, grey.shape[1])
                area = np.s_[a : a + pixels.shape[0], b : b + pixels.shape[1]]
                seen[area] += 1
                assert (pixels == grey[area]).all()
                assert np.abs(denoised - want[area]).max() < 1e-9
        assert (seen == 1).all()


def test_seams_of_a_filter_that_sees_tiles_are_averaged(spark):
    """A filter that gives the tile's mean: a pixel that k tiles share is the mean of k means."""
    x = picture(7, 30, 30)
    cut = tiles.cut(frame(spark, {"a": x}), ["name"], 14, 2)
    parts = [r.asDict() for r in tiles.filtered(cut, ["name"], lambda p: np.full(p.shape, p.mean()), 14, 2, 2).collect()]
    grey, total, count = kernels.grey(x), np.zeros((30, 30)), np.zeros((30, 30))
    for y, y_end, top, bottom in tiles.spans(30, 14, 2):
        for x0, x_end, left, right in tiles.spans(30, 14, 2):
            area = np.s_[max(0, y - 2) : min(30, y_end + 2), max(0, x0 - 2) : min(30, x_end + 2)]
            total[area] += grey[top:bottom, left:right].mean()
            count[area] += 1
    assert count.max() == 4
    groups = {}
    for p in parts:
        groups.setdefault((p["y"], p["x"]), []).append(p)
    for (y, x0), own in groups.items():
        denoised = tiles.joined_cell(own, 14, 2)[1]
        area = np.s_[y : y + denoised.shape[0], x0 : x0 + denoised.shape[1]]
        assert np.abs(denoised - (total / count)[area]).max() < 1e-12


@pytest.mark.parametrize("values", [[0.0], [3.0, 1.0], [5.0] * 40, list(range(1000)), [1e-300, 2.0, 1e300], [0.1] * 19 + [7.0]])
def test_percentile_is_exact(spark, values):
    halves = [values[: len(values) // 2], values[len(values) // 2 :]]
    rows = spark.createDataFrame([(k, np.array(v, float).tobytes()) for k in ("a", None) for v in halves], "name string, residual binary")
    for r in tiles.percentile(rows, ["name"]).collect():
        assert r.abs_p95 == pytest.approx(np.percentile(values, 95), rel=1e-14)


def test_scaling():
    plane = picture(8, 50, 60)[..., 0]
    assert np.allclose(kernels.area_scaled(plane, 25, 20), plane.reshape(25, 2, 20, 3).mean((1, 3)))
    small = kernels.area_scaled(plane, 33, 47)
    assert small.mean() == pytest.approx(plane.mean())
    assert np.allclose(kernels.linear_scaled(np.full((5, 7), 3.0), np.arange(11), np.arange(13), (5, 7), (11, 13)), 3)
    assert tiles.scaled_size(100, 50, 10) == (10, 5) and tiles.scaled_size(9, 10, 10) == (9, 10) and tiles.scaled_size(1, 1000, 10) == (1, 10)


def test_bounds_and_empty(spark):
    with pytest.raises(ValueError):
        tiles.tiled_residuals(frame(spark, {"none": None}), ["name"], side=10, halo=5)
    with pytest.raises(ValueError):
        tiles.filtered(frame(spark, {"none": None}), ["name"], kernels.smoothed, 10, 2, 3)
    assert tiles.tiled_residuals(frame(spark, {"none": None}).limit(0), ["name"]).count() == 0


def test_windows_without_copies_of_the_image(spark):
    """Pixels of every window are the image's, and what is given to Python is the image once."""
    shapes = {"a": picture(1, 64, 70), "b": picture(2, 20, 90), "c": picture(3, 32, 32), "none": None}
    df = images.windowed(frame(spark, shapes), ["name"], 32)
    want = {}
    for name, x in shapes.items():
        if x is None:
            want[name, 0, 0] = (None, None, None)
        elif min(x.shape[:2]) < 32:
            want[name, 0, 0] = (*x.shape[:2], x.tobytes())
        else:
            want |= {(name, y, c): (32, 32, x[y : y + 32, c : c + 32].tobytes()) for y in range(0, x.shape[0] - 31, 16) for c in range(0, x.shape[1] - 31, 16)}
    assert {(r.name, r.y, r.x): (r.win_h, r.win_w, None if r.win is None else bytes(r.win)) for r in df.collect()} == want
    assert "Generate" not in df._jdf.queryExecution().toString()


def test_a_cell_leaves_python_as_one_row(spark):
    """Ranges of a cell's values become rows in Spark, not in Python; the blur is what lines by themselves give."""
    import numpy as np

    from sieveline.functions import image_kernels
    from sieveline.operators import tiles

    size = np.abs(np.random.default_rng(1).normal(size=400))
    rows = spark.createDataFrame([(1, size[:150].tobytes()), (1, size[150:].tobytes())], "vec_id int, residual binary")
    found = tiles.percentile(rows, ["vec_id"])
    assert "Generate inline" in found._jdf.queryExecution().optimizedPlan().toString()
    assert abs(found.first().abs_p95 - np.percentile(size, 95)) < 1e-12
    plane = np.random.default_rng(2).integers(0, 256, (24, 17)).astype(np.uint8)
    kernel = np.exp(-0.5 * np.arange(-3, 4) ** 2.0)
    lines = np.pad(plane.astype(float), 3, mode="edge")
    for axis in (0, 1):
        lines = np.apply_along_axis(np.convolve, axis, lines, kernel / kernel.sum(), mode="valid")
    assert np.allclose(image_kernels.smoothed(plane), lines, rtol=0, atol=1e-12)
