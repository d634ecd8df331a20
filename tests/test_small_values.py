"""Values of small sources, sinks and expressions that no query shows by itself."""

import csv
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from sieveline.functions import image_bytes, results, text
from sieveline.plans import report
from sieveline.sources import readers, writers


def column(spark, rows, kind, make):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}").orderBy("i")
    return [r[0] for r in df.select(make(F.col("c"))).collect()]


def test_first_object_of_a_text(spark):
    rows = ['say {"a":{"b":"}"}} and {"c":1}', "[1,{\"x\":2}]", "{bad} {\"a\":1}", "none", "", None, '{"open": 1', '{"q":"\\"}"}']
    assert column(spark, rows, "string", results.first_json) == ['{"a":{"b":"}"}}', '{"x":2}', None, None, None, None, None, '{"q":"\\"}"}']


def test_pairs_maps_and_looks(spark):
    assert [r and tuple(r) for r in column(spark, [["1", "2"], ["1"], ["1", "x"], None, ["1", "2", "3"], [None, "2"], ["-4", "07"]], "array<string>", results.int_pair)] == [(1, 2), None, None, None, None, None, (-4, 7)]
    maps = [{"a": "1", "b": "2"}, {"a": "1", "b": "2", "c": "3"}, {}, None]
    assert column(spark, maps, "map<string,string>", lambda c: text.truncated_map(c, 2)) == [maps[0], {"a": "1", "b": "2", "__truncated__": "true", "__total_items__": "3"}, {}, None]
    assert column(spark, [' {"a"', "[", "x{", "", None], "string", text.looks_like_json) == [True, True, False, False, None]


def test_lists_of_images_and_videos(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("b.PNG", "a.jpeg", "c.txt", "d.mp4", "deep/e.jpg", "deep/f.mp4"):
        (tmp_path / name).write_bytes(name.encode())
    names = lambda df: [r.path.rsplit("/", 1)[1] for r in df.orderBy("path").collect()]
    assert names(readers.list_images(spark, str(tmp_path))) == ["a.jpeg", "b.PNG"]
    assert sorted(names(readers.list_images(spark, str(tmp_path), recursive=True))) == ["a.jpeg", "b.PNG", "e.jpg"]
    assert [r.path.rsplit("/", 1)[1] for r in readers.list_videos(spark, str(tmp_path)).collect()] == ["d.mp4", "f.mp4"]
    assert {bytes(r.content) for r in readers.list_images(spark, str(tmp_path)).collect()} == {b"a.jpeg", b"b.PNG"}


def test_reviews_as_csv(spark, tmp_path):
    rows = [("k1", 4, 'says "no", twice'), ("k2", None, "plain")]
    writers.write_csv(spark.createDataFrame(rows, "sample_key string, quality int, notes string").coalesce(1), f"{tmp_path}/out")
    (part,) = (tmp_path / "out").glob("part-*.csv")
    found = list(csv.reader(part.read_text().splitlines(), escapechar="\\"))
    assert found == [["sample_key", "quality", "notes"], ["k1", "4", 'says "no", twice'], ["k2", "", "plain"]]


def records(spark):
    rows = []
    for model, right in (("m|1", 8), ("m2", 9), ("m3", 8)):
        for tools in (True, False):
            for i in range(10):
                label = "fake" if i % 2 else "real"
                said = label if i < right else "uncertain"
                rows.append((i, i, model, tools, 0, label, said, None, 0.75, 0.75, 1.0, ["ela"] if tools else [], "v", []))
    schema = "event_id long, sample_id long, model string, use_tools boolean, trial int, label string, prediction string, error string, raw_confidence double, confidence double, latency_seconds double, tool_usage array<string>, vision_model string, tool_details array<struct<tool:string,seconds:double>>"
    return spark.createDataFrame(rows, schema)


def test_ranked_markdown(spark):
    lines = report.ranked_markdown(records(spark), True, "With tools").split("\n")
    assert lines[:4] == ["## With tools", "", "| Rank | Model | N | Accuracy | Coverage | Slip | False flags |", "|:---:|---|---|---|---|---|---|"]
    assert [line.split(" | ")[:5] for line in lines[4:]] == [["| 1", "m2", "10", "0.900", "0.900"], ["| 2", "m3", "10", "0.800", "0.800"], ["| 3", "m\\|1", "10", "0.800", "0.800"]]


def test_png_holds_the_pixels():
    for shape in ((5, 7), (4, 3, 3), (1, 1)):
        x = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
        data, at, body = image_bytes.png(x), 8, b""
        while at < len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            chunk = data[at + 8 : at + 8 + n]
            assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + chunk)
            if kind == b"IHDR":
                assert struct.unpack(">IIBBBBB", chunk) == (shape[1], shape[0], 8, 2 if len(shape) == 3 else 0, 0, 0, 0)
            body += chunk if kind == b"IDAT" else b""
            at += 12 + n
        rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(shape[0], -1)
        assert (rows[:, 0] == 0).all() and (rows[:, 1:] == x.reshape(shape[0], -1)).all()


def test_functions_that_sql_may_call(spark):
    from sieveline.operators import external

    external.register(spark)
    df = spark.createDataFrame([(1, bytearray(b"\xff\xd8x")), (2, bytearray(b"GIF8<x:xmpmeta>a</x:xmpmeta>")), (3, None)], "i int, c binary")
    df.createOrReplaceTempView("small_files")
    found = spark.sql("SELECT i, image_format(c) AS f, image_xmp(c) AS x FROM small_files ORDER BY i").collect()
    assert [tuple(r) for r in found] == [(1, "JPEG", None), (2, "GIF", "<x:xmpmeta>a</x:xmpmeta>"), (3, "unknown", None)]
