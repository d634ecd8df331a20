import hashlib
import zlib

import numpy as np
import pytest

from sieveline.llm import jpeg, media


def payloads():
    rng = np.random.default_rng(0)
    out = []
    for i in range(36):
        n = 64 * int(rng.integers(1, 40))
        sparse = np.full(n, 128)
        sparse[rng.integers(0, n, max(1, n // 40))] = rng.integers(0, 256, max(1, n // 40))
        ones = np.full(n, 128)
        ones[rng.integers(0, n, max(1, n // 30))] = 129
        out.append([rng.integers(0, 256, n), rng.integers(126, 131, n), sparse, ones, rng.choice([128] * 20 + [127, 129, 0, 255], n), np.zeros(n)][i % 6].astype(np.uint8).tobytes())
    return out


@pytest.mark.parametrize("tallest", [jpeg.TALLEST, 3])
def test_payloads_round_trip(monkeypatch, tallest):
    monkeypatch.setattr(jpeg, "TALLEST", tallest)
    jpeg._orders.clear()
    data = payloads()
    files, tables, _ = jpeg.decode(jpeg.encode(data))
    assert [jpeg.payload(f, t) for f, t in zip(files, tables, strict=True)] == data
    jpeg._orders.clear()


def _read(spark, raw):
    """Pixels that the JVM's own reader finds."""
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(raw))
    w, h = image.getWidth(), image.getHeight()
    return np.array([image.getRGB(x, y) & 0xFFFFFF for y in range(h) for x in range(w)]).reshape(h, w)


def test_other_readers_see_the_same_image(spark):
    rng = np.random.default_rng(1)
    smooth = np.full((12, 64), 128)
    smooth[:, 0] = rng.integers(40, 216, 12)
    smooth[:, 1:4] += rng.integers(-9, 9, (12, 3))
    raw = jpeg.encode([smooth.astype(np.uint8).tobytes()])[0]
    _, _, (rgb,) = jpeg.decode([raw])
    theirs = _read(spark, raw)
    theirs = np.stack([theirs >> 16, theirs >> 8 & 255, theirs & 255], 2)
    assert theirs.shape == rgb.shape
    # their chroma is interpolated, ours repeated; luma must agree
    luma = np.array([0.299, 0.587, 0.114])
    assert np.abs(theirs @ luma - rgb @ luma).max() < 4


def _written(spark, rgb):
    """A progressive JPEG of the JVM's own writer."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    h, w, _ = rgb.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            r, g, b = map(int, rgb[y, x])
            image.setRGB(x, y, r << 16 | g << 8 | b)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    how.setProgressiveMode(1)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    stream.flush()
    del gateway
    return bytes(out.toByteArray())


def test_reads_files_of_another_writer(spark):
    y, x = np.mgrid[0:37, 0:53]
    rgb = np.stack([x * 4, y * 6, 255 - x * 2 - y], 2).clip(0, 255).astype(np.uint8)
    raw = _written(spark, rgb)
    files, _, (ours,) = jpeg.decode([raw])
    assert len(files[0].scans) > 4 and any(s.ah for s in files[0].scans)
    theirs = _read(spark, raw)
    theirs = np.stack([theirs >> 16, theirs >> 8 & 255, theirs & 255], 2).astype(int)
    assert ours.shape == (37, 53, 3)
    luma = np.array([0.299, 0.587, 0.114])
    assert np.abs(theirs @ luma - ours @ luma).max() < 5
    assert np.abs(theirs - ours).mean() < 5


def test_refuses_other_files():
    with pytest.raises(ValueError):
        jpeg.parse(b"GIF89a")


TEXTS = [(1, "short"), (2, None), (3, ""), (4, "é漢😀" * 500), (5, "short"), (None, "x" * 64), (5, "y" * 300_001)]


def test_texts_are_stored_without_loss(spark):
    docs = spark.createDataFrame([(i, t, "m", 3) for i, t in TEXTS], "doc_id long, text string, media string, n_bytes int")
    found = [tuple(r)[:5] for r in media.digest(media.store(docs)).collect()]
    want = []
    for i, t in TEXTS:
        raw = (t or "").encode()
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((i, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])))
    assert sorted(found, key=repr) == sorted(want, key=repr)
    back = [tuple(r) for r in media.texts(media.store(docs)).collect()]
    assert sorted(back, key=repr) == sorted(((i, t or "") for i, t in TEXTS), key=repr)


def test_equal_texts_are_equal_files_wherever_they_stand(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 3 else "x" * i) for i in range(60)], "doc_id long, text string")
    rows = media.digest(media.store(docs.repartition(7))).filter("doc_id % 3 <> 0").select("media_sha256", "feature").distinct().collect()
    assert len(rows) == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert media.digest(media.store(docs)).count() == 0
    assert media.tensors(media.store(docs)).count() == 0
