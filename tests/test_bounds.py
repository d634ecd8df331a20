"""Bounds of metadata are parameters: without them nothing is lost, however far in the file it lies."""

import random

from pyspark.sql import functions as F

from sieveline.functions import image_bytes as files
from sieveline.operators import images, ranking


def test_a_packet_and_a_term_beyond_the_default_bound(spark):
    packet = b"<x:xmpmeta>" + b"c2pa " * 4000
    data = b"\x89PNG" + bytes(files.SCAN) + packet
    df = spark.createDataFrame([(1, bytearray(data))], "id int, content binary")
    bounded = images.metadata(df, ["id"]).first()
    whole = images.metadata(df, ["id"], scan=None, window=None).first()
    assert bounded.xmp is None and list(bounded.credential_hints) == []
    assert whole.xmp == packet.decode() and list(whole.credential_hints) == ["c2pa", "xmp:c2pa"]
    assert len(images.metadata(df, ["id"], scan=None).first().xmp) == files.XMP_WINDOW
    assert images.metadata(df, ["id"], scan=len(data)).first().xmp is not None


def test_all_tags_without_a_bound():
    import struct

    tags = list(range(0x5000, 0x5000 + 90))
    entries = b"".join(struct.pack("<HHII", t, 3, 1, i + 1) for i, t in enumerate(tags))
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0)
    body = b"Exif\0\0" + tiff
    data = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9"
    assert len(files.exif(data)) == files.MOST_TAGS and len(files.exif(data, None)) == 90


def test_flat_names_and_places_of_outliers(spark):
    rng = random.Random(1)
    rows = [(i, f"d{rng.randrange(9)}", rng.choice(["a", "b", None, f"n{i}"]), rng.choice(["g", "h", None]), rng.choice([-3.0, -2.0, 0.5, 2.0, 3.0]) + rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, folder string, name string, g string, z double").repartition(5)
    first = {}
    for i, _, name, *_ in rows:
        first.setdefault(name, i)
    want = {(i, name if first[name] == i else None if name is None else f"{folder}_{name}") for i, folder, name, *_ in rows}
    assert {(r.id, r.flat_name) for r in ranking.flattened(df, "folder", "name", "id").collect()} == want
    places = {}
    for g in ("g", "h", None):
        for side, own in (("low", [r for r in rows if r[3] == g and r[4] < -1.9]), ("high", [r for r in rows if r[3] == g and r[4] > 1.9])):
            places |= {r[0]: (side, p) for p, r in enumerate(sorted(own, key=lambda r: (-abs(r[4]), r[0])), 1)}
    found = ranking.outliers(df, ["g"], "z", 1.9, "id")
    assert {r.id: (r.side, r.place) for r in found.collect()} == places
    assert dict(found.dtypes)["place"] == "int" and found.columns == [*df.columns, "side", "place"]
    assert ranking.outliers(df.filter(F.lit(False)), ["g"], "z", 1.9, "id").count() == 0
