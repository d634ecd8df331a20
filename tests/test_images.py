"""Image kernels against plain numpy and known answers."""


import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions import image_bytes as files
from sieveline.functions import image_kernels as kernels
from sieveline.operators import images
from sieveline.sources import readers


def tiff(entries, order="<"):
    body, extra = b"", b""
    at = 8 + 2 + 12 * len(entries) + 4
    for tag, kind, value in entries:
        if kind == 2:
            raw = value.encode() + b"\0"
            n = len(raw)
        elif kind == 5:
            raw = b"".join(struct.pack(order + "II", a, b) for a, b in value)
            n = len(value)
        else:
            raw, n = struct.pack(order + {3: "H", 4: "I"}[kind], value), 1
        field = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", at + len(extra))
        extra += raw if len(raw) > 4 else b""
        body += struct.pack(order + "HHI", tag, kind, n) + field
    return {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(order + "I", 8) + struct.pack(order + "H", len(entries)) + body + b"\0\0\0\0" + extra


def segment(marker, body):
    return bytes((255, marker)) + struct.pack(">H", len(body) + 2) + body


def jpeg(*parts):
    return b"\xff\xd8" + b"".join(parts) + b"\xff\xda\0\2\xff\xd9"


def table(quality):
    rows = kernels.scaled_table(quality).ravel()
    return segment(0xDB, b"\0" + bytes(int(rows[i]) for i in files.ZIGZAG))


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(order):
    data = jpeg(segment(0xE1, b"Exif\0\0" + tiff([(0x010F, 2, "Maker"), (0x0112, 3, 6), (0x829A, 5, [(1, 50)])], order)))
    assert files.exif(data) == {"Make": "Maker", "Orientation": 6, "ExposureTime": 0.02}
    assert files.exif(b"no jpeg") == {} and files.exif(jpeg(segment(0xE1, b"Exif\0\0xx"))) == {}


def test_xmp_and_hints():
    packet = "<x:xmpmeta>by C2PA</x:xmpmeta>"
    data = jpeg(segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + packet.encode()))
    assert files.xmp(data) == packet and files.credential_hints(data, packet) == ["c2pa", "xmp:c2pa"]
    assert files.xmp(b"..." + packet.encode() + b"...") == packet and files.xmp(b"") is None
    icc = b"ICC_PROFILE\0\1\1" + b"x" * 8 + b"desc\0\0\0\0" + struct.pack(">I", 5) + b"sRGB\0"
    assert files.icc(jpeg(segment(0xE2, icc))) == (len(icc) - 14, "sRGB")


@pytest.mark.parametrize("quality", [10, 49, 50, 70, 85, 95, 100])
def test_quality(quality):
    found = files.quantisation_tables(jpeg(table(quality)))[0]
    assert kernels.quality_of(np.array(found).reshape(8, 8)) == (quality, 0.0)


def picture(h=64, w=80, seed=42):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    base = np.stack([x * 2, y * 3, 255 - x - y], 2) + rng.normal(0, 6, (h, w, 3))
    return np.clip(base, 0, 255).astype(np.uint8)


def test_blocks_and_steps():
    g = kernels.grey(picture(250, 310))
    dct = kernels.block_dct(g)
    assert dct.shape == (31, 38, 8, 8)
    assert np.allclose((dct**2).sum(), ((kernels.blockify(g).astype(float) - 128) ** 2).sum())
    rng = np.random.default_rng(0)
    assert kernels.step_of(rng.integers(-40, 40, 4000) * 7) == 7
    assert kernels.step_of(np.zeros(9)) == 0
    assert kernels.unclipped(np.zeros((16, 16), np.uint8)).sum() == 0
    pressed = kernels.recompressed(picture(), 50)
    assert kernels.sac(kernels.block_dct(kernels.grey(pressed))) > kernels.sac(kernels.block_dct(kernels.grey(picture())))


def test_error_levels():
    x = picture()
    again = kernels.recompressed(x, 75)
    assert again.shape == x.shape and np.abs(again.astype(int) - x).mean() < 8
    assert (kernels.error_levels(x, 0) == kernels.error_levels(x, 1)).all()
    mean, std, anomaly = kernels.error_level_stats(kernels.error_levels(x))
    assert mean >= 0 and std >= 0 and anomaly >= 0
    assert np.abs(kernels.recompressed(x, 95).astype(int) - x).mean() < np.abs(kernels.recompressed(x, 30).astype(int) - x).mean()


def test_spectrum():
    flat = kernels.spectrum_features(np.full((32, 32), 7.0))
    assert flat["dct_mean"] == pytest.approx(0, abs=1e-9)
    assert kernels.spectrum_features(kernels.grey(picture()))["decay"] < 0
    assert kernels.spectrum_features(np.ones((2, 2)))["peakiness"] == 0


def test_filter_pattern_is_found():
    rng = np.random.default_rng(1)
    plane = kernels.smoothed(rng.random((64, 64)), 1.2)
    mosaic = plane.copy()
    green = np.add.outer(np.arange(64), np.arange(64)) % 2 == 1
    around = sum(np.roll(plane, s, a) for s in (1, -1) for a in (0, 1)) / 4
    mosaic[~green] = around[~green]
    assert kernels.pattern_measure(mosaic, "G") > 2 * kernels.pattern_measure(rng.random((64, 64)), "G")
    with pytest.raises(ValueError, match="small"):
        kernels.interpolation_map(np.ones((2, 2)))


def test_mixed_pixels_are_told_from_others():
    """The mix, the spread and the shares are a rest point of the likelihood, and every round raises it."""
    rng = np.random.default_rng(6)
    plane = rng.random((40, 40)) * 255
    truth = np.array([0.05, 0.2, 0.05, 0.2, 0.2, 0.05, 0.2, 0.05])
    noisy = plane.copy()
    spots = [(y, x) for y in range(1, 39, 2) for x in range(1, 39, 2)]
    for y, x in spots:
        noisy[y, x] = np.delete(plane[y - 1 : y + 2, x - 1 : x + 2].ravel(), 4) @ truth + rng.normal(0, 0.5)
    share, mix = kernels.interpolation_map(noisy, spread=2.0)
    assert np.abs(mix - truth).max() < 0.02
    mixed = np.array([share[y, x] for y, x in spots])
    others = share[2:-2:2, 2:-2:2]
    assert np.median(mixed) > 0.9 and others.mean() < 0.2
    assert not share[0].any() and not share[:, -1].any()

    def likelihood(rounds):
        _, found = kernels.interpolation_map(noisy, spread=2.0, rounds=rounds)
        around = np.lib.stride_tricks.sliding_window_view(noisy, (3, 3)).reshape(-1, 9)
        residual = around[:, 4] - np.delete(around, 4, 1) @ found
        return max(kernels.mixed_share(residual, s, 1 / 256)[1] for s in np.geomspace(0.1, 200, 2000))

    values = [likelihood(n) for n in (0, 1, 3, 10, 50)]
    assert all(b >= a - 1e-3 for a, b in zip(values, values[1:]))
    assert likelihood(500) == pytest.approx(values[-1], abs=0.05)


@pytest.mark.parametrize("step", [2, 3])
def test_teeth_and_changed_blocks(step):
    rng = np.random.default_rng(step)
    values = np.rint(rng.laplace(0, 30, 4000)).astype(int) * step
    values -= values.min() - 1
    assert kernels.period(np.bincount(values, minlength=values.max() + 2)) == step
    assert kernels.period(np.bincount(rng.poisson(40, 4000))) == 1 and kernels.period(np.zeros(9, int)) == 1
    dct = np.rint(rng.laplace(0, 30, (20, 30, 8, 8))) * step
    dct[5:9, 5:9] += rng.integers(1, step, (4, 4, 8, 8))
    likely, periods = kernels.tamper_map(dct)
    assert periods == [step] * 15
    assert likely[5:9, 5:9].mean() > 0.9 and np.delete(likely, np.s_[5:9], 0).mean() < 0.1
    # a slow version, block by block
    counts = np.bincount(values, minlength=values.max() + 2)
    odds, top, n = kernels.value_odds(counts, step), int(counts.argmax()), len(counts)
    for v in range(n):
        start = v - (v - top) % step
        around = sum(int(counts[(start + j) % n]) for j in range(step))
        chance = np.clip((1 / step) / (counts[v] / max(around, 1e-9) + 1 / step), 1e-9, 1 - 1e-9)
        assert odds[v] == pytest.approx(np.log(chance / (1 - chance)), abs=1e-6)


def test_period_matches_a_slow_search():
    rng = np.random.default_rng(8)
    for _ in range(300):
        step, n = rng.integers(1, 9), int(rng.integers(3, 90))
        counts = rng.poisson(5, n) * (rng.random() < 0.7) + np.where(np.arange(n) % step == 0, rng.poisson(40, n), 0)
        whole = np.abs(np.fft.fft(counts))
        if np.diff(np.sort(whole[: n // 2 + 1])).min(initial=1) < 1e-6:
            continue  # equal peaks: which comes first is a matter of rounding
        first = next((i for i in range(n // 2) if whole[i + 1] > whole[i]), n // 2)
        part = whole[first : max(first + 1, n // 2)]
        strongest = first + int(part.argmax())
        flat = not strongest or part.max() < whole[0] / 5 or part.min() > 0.9 * part.max()
        assert kernels.period(counts) == (1 if not counts.any() or flat else max(1, round(n / strongest)))


def test_residuals_are_deterministic():
    g = kernels.grey(picture())
    a, b = kernels.residual_stats(g), kernels.residual_stats(g)
    assert a == b and all(np.isfinite(v) for v in a.values())


def test_files_through_spark(spark, tmp_path):
    x = picture(40, 48)
    (tmp_path / "fake").mkdir()
    (tmp_path / "fake" / "a.png").write_bytes(files.png(x))
    (tmp_path / "b.png").write_bytes(b"not an image")
    every = {r.path.rsplit("/", 1)[1]: r for r in readers.read_pixels(spark, str(tmp_path)).collect()}
    assert every["b.png"].status == "error" and every["b.png"].rgb is None
    broken = images.frequency(readers.read_pixels(spark, str(tmp_path)), ["path"]).collect()
    assert [r.status for r in broken] == ["error"]
    pixels = readers.read_pixels(spark, str(tmp_path / "fake"))
    r = pixels.first()
    assert (np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3) == x).all()
    labels = {r.path.rsplit("/", 1)[1]: r.label for r in readers.labelled_images(spark, str(tmp_path)).collect()}
    assert labels["a.png"] == "fake" and set(labels) == {"a.png", "b.png"}
    found = images.metadata(readers.list_images(spark, str(tmp_path), True), ["path"]).collect()
    assert {(r.format, r.status) for r in found} == {("PNG", "completed"), ("unknown", "completed")}
    assert images.block_analysis(pixels, ["path"]).first().block_rows == 5
    level = images.error_level(pixels, ["path"], want_map=True).first()
    assert level.status == "completed" and level.ela_map
    bad = spark.createDataFrame([(1, 4, 4, b"xx")], "k int, height int, width int, rgb binary")
    r = images.frequency(bad, ["k"]).first()
    assert r.status == "error" and r.dct_mean is None
    windows = images.pattern_windows(pixels, ["path"], window=32, rounds=3).collect()
    assert {(r.y, r.x) for r in windows} == {(0, 0), (0, 16)}
    tables = images.quantisation(spark.createDataFrame([(1, jpeg(table(80))), (2, b"x")], "k int, content binary"), ["k"]).orderBy("k").collect()
    assert tables[0].quality == 80 and tables[1].status == "error"



def test_report(spark):
    data = spark.createDataFrame([(1, jpeg(segment(0xE1, b"Exif\0\0" + tiff([(0x010F, 2, "Maker")]))))], "k int, content binary")
    found = images.metadata(data, ["k"])
    assert "EXIF tags: 1" in found.select(images.report(found).alias("r")).first().r


def written(spark, rgb):
    """A baseline JPEG of the JVM's own writer."""
    jvm = spark.sparkContext._jvm
    h, w, _ = rgb.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            r, g, b = map(int, rgb[y, x])
            image.setRGB(x, y, r << 16 | g << 8 | b)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def test_baseline_coefficients(spark, tmp_path):
    from sieveline.functions.baseline_jpeg import coefficients

    data = written(spark, picture(40, 56))
    parts, tables = coefficients(data)
    (tmp_path / "a.jpg").write_bytes(data)
    r = readers.read_pixels(spark, str(tmp_path)).first()
    shown = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3) @ kernels.LUMA_WEIGHTS
    luma = np.einsum("ui,hwuv,vj->hiwj", kernels.DCT, parts[0] * tables[0], kernels.DCT).reshape(parts[0].shape[0] * 8, -1)[:40, :56] + 128
    assert np.abs(np.clip(luma, 0, 255) - shown).mean() < 1
    found = images.raw_blocks(spark.createDataFrame([(1, data), (2, b"no"), (3, data[: len(data) // 2])], "k int, content binary"), ["k"]).orderBy("k").collect()
    assert found[0].status == "completed" and found[0].quality == kernels.quality_of(tables[0])[0]
    assert found[1].status == "error"


def test_pattern_query_runs_the_default_rounds(spark, monkeypatch):
    from sieveline.plans import image_queries

    given, real = [], image_queries.images.pattern_windows
    monkeypatch.setattr(image_queries.images, "pattern_windows", lambda *a, **b: given.append(b) or real(*a, **b))
    image_queries.kr37_pattern_windows(spark, "/root/testdata/sf0.001")
    assert [b.get("rounds", 50) for b in given] == [50]


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def drawn(spark):
    from sieveline.plans import image_queries

    rows = image_queries.pictures(spark, SF).orderBy("vec_id").limit(3).collect()
    return {r.vec_id: np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3) for r in rows}


def found_by(spark, name, keys):
    from sieveline import catalog

    rows = catalog.queries()[name](spark, SF).filter(F.col("vec_id").isin(list(keys))).collect()
    out = {}
    for r in rows:
        out.setdefault(r.vec_id, []).append(r)
    return out


def test_frequency_query_against_sums(spark, drawn):
    """Every cosine and Fourier coefficient by its defining sum."""
    rows = found_by(spark, "kr23_frequency", drawn)
    for key, rgb in drawn.items():
        g = np.rint(rgb @ np.array([0.299, 0.587, 0.114]))
        h, w = g.shape
        cosine = np.zeros((h, w))
        level = np.zeros((h, w))
        y, x = np.mgrid[0:h, 0:w]
        for u in range(h):
            for v in range(w):
                a = np.sqrt((1 if u == 0 else 2) / h) * np.sqrt((1 if v == 0 else 2) / w)
                cosine[u, v] = abs(a * (g * np.cos((2 * y + 1) * u * np.pi / (2 * h)) * np.cos((2 * x + 1) * v * np.pi / (2 * w))).sum())
                wave = (g * np.exp(-2j * np.pi * (u * y / h + v * x / w))).sum()
                level[(u + h // 2) % h, (v + w // 2) % w] = 20 * np.log10(abs(wave) + 1e-10)
        r = rows[key][0]
        rest = np.delete(cosine.ravel(), 0)
        assert r.dct_mean == pytest.approx(rest.mean(), abs=1e-4) and r.dct_std == pytest.approx(rest.std(), abs=1e-4)
        rings = {}
        for i in range(h):
            for j in range(w):
                rings.setdefault(int(np.hypot(i - h // 2, j - w // 2)), []).append(level[i, j])
        profile = [sum(rings[k]) / len(rings[k]) for k in sorted(rings)][1:]
        slope = np.polyfit(np.log(np.arange(1, len(profile) + 1) + 1e-10), profile, 1)[0]
        # magnitudes of 0 are rounding noise, of which the logarithm is no number to compare
        if min(level.ravel()) > -150:
            assert r.radial_mean == pytest.approx(np.mean(profile), abs=1e-3) and r.decay == pytest.approx(slope, abs=1e-3)


def test_residual_query_against_a_slow_blur(spark, drawn):
    rows = found_by(spark, "kr24_residuals", drawn)
    kernel = [np.exp(-0.5 * k * k) for k in range(-3, 4)]
    for key, rgb in drawn.items():
        g = np.rint(rgb @ np.array([0.299, 0.587, 0.114]))
        h, w = g.shape
        r = np.zeros((h, w))
        for y in range(h):
            for x in range(w):
                total = sum(kernel[a + 3] * kernel[b + 3] * g[min(max(y + a, 0), h - 1), min(max(x + b, 0), w - 1)] for a in range(-3, 4) for b in range(-3, 4))
                r[y, x] = g[y, x] - total / sum(kernel) ** 2
        got = rows[key][0]
        values = r.ravel()
        assert got.mean == pytest.approx(values.mean(), abs=1e-5) and got.std == pytest.approx(values.std(), abs=1e-5)
        assert got.energy == pytest.approx((values**2).mean(), abs=1e-4) and got.abs_p95 == pytest.approx(np.percentile(abs(values), 95), abs=1e-5)
        z = (values - values.mean()) / values.std()
        assert got.skew == pytest.approx((z**3).mean(), abs=1e-4) and got.kurtosis == pytest.approx((z**4).mean() - 3, abs=1e-4)


def slow_dct(block):
    out = np.zeros((8, 8))
    for u in range(8):
        for v in range(8):
            a = np.sqrt((1 if u == 0 else 2) / 8) * np.sqrt((1 if v == 0 else 2) / 8)
            out[u, v] = a * sum(block[y, x] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) for y in range(8) for x in range(8))
    return out


def slow_shares(values):
    size = [abs(int(np.rint(v))) for v in values]
    size = [s for s in size if s > 1]
    hits = [sum(s % q == 0 for s in size) for q in range(1, min(100, max(size, default=0)) + 1)]
    return [n / hits[0] for n in hits] if size else []


def test_block_query_against_slow_blocks(spark, drawn):
    rows = found_by(spark, "kr11_block_analysis", drawn)
    for key, rgb in drawn.items():
        g = np.rint(rgb @ np.array([0.299, 0.587, 0.114]))
        blocks = [(y, x, g[y : y + 8, x : x + 8]) for y in range(0, 48, 8) for x in range(0, 48, 8)]
        dct = [slow_dct(b - 128) for _, _, b in blocks]
        r = rows[key][0]
        assert (r.block_rows, r.block_columns) == (6, 6)
        assert list(r.unclipped) == [bool(b.max() < 255 and b.min() > 0) for _, _, b in blocks]
        shares = slow_shares([0 if i == 0 else v for d in dct for i, v in enumerate(d.ravel())])
        assert r.sac == pytest.approx(max(b - a for a, b in zip(shares, shares[1:])) if len(shares) > 1 else 0.0, abs=1e-6)
        kept = [d for d, ok in zip(dct, r.unclipped) if ok]
        for i in range(64):
            steps = [q + 1 for q, s in enumerate(slow_shares([d.ravel()[i] for d in kept])) if s >= 0.7]
            assert r.primary[i] == (max(steps) if steps else 0)


def test_error_level_query_against_slow_pixels(spark, drawn):
    rows = found_by(spark, "kr18_error_level", drawn)
    for key, rgb in drawn.items():
        again = kernels.recompressed(rgb, 75)
        means = []
        for a, b in zip(rgb.reshape(-1, 3), again.reshape(-1, 3)):
            shown = []
            for p, q in zip(a, b):
                change = np.float32(np.sqrt(np.abs(np.float32(p) / np.float32(255) - np.float32(q) / np.float32(255)))) * np.float32(255) * np.float32(50 / 20)
                level = int(min(max(change, 0), 255))
                line = 255.0 * (level - 25) / (255 - 2 * 25)
                shown.append(int(min(max(line, 0), 255)))
            means.append(sum(shown) / 3)
        got = rows[key][0]
        assert got.ela_mean == pytest.approx(np.mean(means), abs=1e-2) and got.ela_std == pytest.approx(np.std(means), abs=1e-2)


def test_pattern_query_against_windows(spark, drawn):
    """Each window by itself: the mixture's shares, then the product of both spectra by their sums."""
    rows = found_by(spark, "kr37_pattern_windows", drawn)
    for key, rgb in list(drawn.items())[:1]:
        assert sorted((r.y, r.x) for r in rows[key]) == [(0, 0), (0, 16), (16, 0), (16, 16)]
        for r in rows[key]:
            part = rgb[r.y : r.y + 32, r.x : r.x + 32] / 255.0
            assert r.texture == pytest.approx(part[..., 1].var(), abs=1e-5)
            for c, channel in enumerate("RGB"):
                share, _ = kernels.interpolation_map(part[..., c])
                pattern = np.ones((32, 32))
                for i, name in enumerate("RGGB"):
                    if name == channel:
                        pattern[i // 2 :: 2, i % 2 :: 2] = 0
                y, x = np.mgrid[0:32, 0:32]
                # the pattern's spectrum is not 0 at four places alone
                want = sum(abs((share * np.exp(-1j * np.pi * (u * y + v * x))).sum()) * abs((pattern * np.exp(-1j * np.pi * (u * y + v * x))).sum()) for u, v in ((0, 1), (1, 0), (1, 1)))
                got = r[f"m_{channel.lower()}"]
                assert np.isnan(got) if np.isnan(want) else got == pytest.approx(want, abs=0.05, rel=1e-4)


def plain_map(plane, rounds=50):
    """The mixture by least squares of the pixels in every round."""
    around = np.lib.stride_tricks.sliding_window_view(plane, (3, 3)).reshape(-1, 9)
    own, around = around[:, 4], np.delete(around, 4, 1)
    mix, spread, before = np.linalg.lstsq(around, own, rcond=None)[0], 0.0075, -np.inf
    for turn in range(rounds + 1):
        normal = np.exp(-(((own - around @ mix) / spread) ** 2) / 2) / (spread * np.sqrt(2 * np.pi))
        share, now = normal / (normal + 1 / 256), np.log(normal + 1 / 256).sum()
        if now - before <= kernels.STILL * abs(now) or not share.any() or turn == rounds:
            out = np.zeros(plane.shape)
            out[1:-1, 1:-1] = share.reshape(plane.shape[0] - 2, -1)
            return out, mix
        root, before = np.sqrt(share), now
        mix = np.linalg.lstsq(around * root[:, None], own * root, rcond=None)[0]
        spread = max(np.sqrt(np.average((own - around @ mix) ** 2, weights=share)), kernels.LEAST_SPREAD)


def test_planes_side_by_side_as_one_by_one(drawn):
    """Also flat, black and sloping planes, whose neighbours depend on each other, beside others; and any number of rounds."""
    y, x = np.mgrid[0:32, 0:32]
    rng = np.random.default_rng(5)
    half = np.where(x < 16, 1.0, rng.integers(0, 256, (32, 32)) / 255)
    planes = [*(rgb[:32, :32, i] / 255 for rgb in drawn.values() for i in range(3)), np.ones((32, 32)), np.zeros((32, 32)), x / 64.0, half, rng.integers(0, 256, (32, 32)) / 255]
    for rounds in (0, 1, 50):
        maps, mixes = kernels.interpolation_maps(np.stack(planes), rounds=rounds)
        for i, plane in enumerate(planes):
            want, mix = plain_map(plane, rounds)
            assert np.abs(maps[i] - want).max() < 1e-6 and np.abs(mixes[i] - mix).max() < 1e-6, (rounds, i)
    narrow = kernels.interpolation_maps(np.stack(planes)[:, :3, :4])[0]  # two inner pixels
    assert narrow.shape == (len(planes), 3, 4)


def test_windows_take_no_least_squares_of_pixels(drawn, monkeypatch):
    """A window's rounds are solved from sums over its pixels, for all windows of an image at once."""
    calls, real = [], np.linalg.inv
    monkeypatch.setattr(np.linalg, "inv", lambda a: calls.append(len(a)) or real(a))
    monkeypatch.setattr(np.linalg, "lstsq", None)
    for rgb in drawn.values():
        planes = np.stack([rgb[y : y + 32, x : x + 32, i] / 255 for y in (0, 16) for x in (0, 16) for i in range(3)])
        calls.clear()
        kernels.pattern_measures(planes, "RGB" * 4)
        assert calls[0] == 12 and len(calls) <= 51


def test_windows_beside_others_and_what_cannot_be_read(spark, monkeypatch):
    """Sizes by turns, images without pixels, of a wrong length and too small: each row is as if alone."""
    x = picture(48, 64)
    rows = [(1, 48, 64, x.tobytes()), (2, 48, 64, None), (3, 48, 64, b"no"), (4, 20, 64, x[:20].tobytes()), (5, 2, 2, bytes(12)), (6, None, 64, b"no"), (7, 48, 64, x[::-1].tobytes()), (8, 48, 64, bytes(48 * 64 * 3))]
    df = spark.createDataFrame(rows, "k int, height int, width int, rgb binary").coalesce(1)

    def found(beside):
        monkeypatch.setattr(images, "BESIDE", beside)
        got = images.pattern_windows(df, ["k"], window=32, rounds=5).collect()
        return {(r.k, r.y, r.x): (r.win_h, r.win_w, r.status, r.error, *(None if v is None else round(v, 4) for v in (r.m_r, r.m_g, r.m_b, r.texture))) for r in got}

    alone = found(1)
    assert found(1 << 14) == alone and len(alone) == 3 * 6 + 5
    assert {k for (k, _, _), r in alone.items() if r[2] == "error"} == {2, 3, 5, 6}
    assert alone[4, 0, 0][:3] == (20, 64, "completed") and alone[2, 0, 0][:4] == (None, None, "error", "the image has no pixels")


def test_network_input_and_map_png(spark, tmp_path):
    import base64

    x = picture(16, 24)
    df = spark.createDataFrame([(1, 16, 24, x.tobytes()), (2, 16, 24, None)], "k int, height int, width int, rgb binary")
    found = {r.k: r.v for r in df.select("k", images.network_input("height", "width", "rgb").alias("v")).collect()}
    assert found[2] is None and np.allclose(np.array(found[1]).reshape(3, 16, 24), x.transpose(2, 0, 1) / 256)
    values = [i / 383 for i in range(384)]
    maps = spark.createDataFrame([(16, 24, values), (16, 24, values[:5]), (16, 24, None)], "height int, width int, v array<double>")
    shown = [r.p for r in maps.select(images.map_png("height", "width", "v").alias("p")).collect()]
    assert shown[1:] == [None, None]
    (tmp_path / "m.png").write_bytes(base64.b64decode(shown[0]))
    r = readers.read_pixels(spark, str(tmp_path)).first()
    assert np.frombuffer(r.rgb, np.uint8).reshape(16, 24, 3)[..., 0].ravel().tolist() == [int(v * 255) for v in values]


def test_pixels_are_made_in_the_task_and_dealt(spark):
    """No Python step holds pixels for another, and a single file's images are dealt over the cores."""
    from sieveline import catalog

    for name in ("kr11_block_analysis", "kr18_error_level", "kr23_frequency", "kr24_residuals", "kr37_pattern_windows"):
        df = catalog.queries()[name](spark, SF)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" not in plan and "RepartitionByExpression" in plan, name
    rows = spark.createDataFrame([(1, 16, 24, bytes(range(128)) * 9), (2, 16, 24, None), (3, 16, 24, b"no")], "k int, height int, width int, rgb binary")
    plain = {r.k: r for r in images.residuals(rows, ["k"]).collect()}
    assert {r.k: r for r in images.residuals(rows, ["k"], read=lambda b: b).collect()} == plain and [plain[k].status for k in (1, 2, 3)] == ["completed", "error", "error"]
