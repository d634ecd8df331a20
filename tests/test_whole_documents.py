import threading

import pytest
from pyspark.sql import functions as F

from sieveline.sources import prefixes, readers, writers


def test_readers_of_a_document_see_a_version_whole(spark, tmp_path):
    """A reader in a loop during fifty replaces sees all rows of one version each time."""
    path, seen, stop = f"{tmp_path}/doc", [], threading.Event()
    writers.publish(spark.range(0, 40, 1, 3).withColumn("version", F.lit(0)), path)

    def look():
        while not stop.is_set():
            rows = spark.read.schema("id long, version int").json(writers.current(spark, path)).collect()
            seen.append((len(rows), {r.version for r in rows}))

    reader = threading.Thread(target=look)
    reader.start()
    for v in range(1, 51):
        writers.publish(spark.range(0, 40 + v, 1, 3).withColumn("version", F.lit(v)), path)
    stop.set()
    reader.join()
    assert len(seen) > 5 and all(len(v) == 1 and n == 40 + min(v) for n, v in seen)
    assert len(list(tmp_path.glob("doc/_current-*"))) == writers.VERSIONS == len(list(tmp_path.glob("doc/_rows-*")))


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    path = f"{tmp_path}/doc"
    assert writers.current(spark, path) == path
    writers.publish(spark.range(3), path)
    before = writers.current(spark, path)
    broken = spark.range(5).select(F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("no"))).alias("id"))
    with pytest.raises(Exception, match="no"):
        writers.publish(broken, path)
    assert writers.current(spark, path) == before and spark.read.schema("id long").json(before).count() == 3
    assert len(list(tmp_path.glob("doc/_rows-*"))) == 1
    writers.publish(spark.range(2), path, versions=1)
    assert len(list(tmp_path.glob("doc/_rows-*"))) == 1 and spark.read.schema("id long").json(writers.current(spark, path)).count() == 2


def test_plain_documents_survive_a_failed_move(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/doc"
    for n in (3, 2):
        writers.save_whole(spark.range(n), path)
        assert spark.read.schema("id long").json(path).count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["doc"]


def test_reviews_are_read_from_either_kind(spark, tmp_path):
    doc = spark.createDataFrame([({"k": {"reasoning_quality": 4}},)], "evaluations map<string,struct<reasoning_quality:int>>")
    writers.publish(doc, f"{tmp_path}/new")
    writers.save_whole(doc, f"{tmp_path}/old")
    for name in ("new", "old"):
        assert [(r.sample_key, r.reasoning_quality) for r in readers.read_reviews(spark, f"{tmp_path}/{name}").collect()] == [("k", 4)]


def test_prefixes_read_no_more_than_they_are_asked(spark, tmp_path):
    """Files of 10 GB each that hold no blocks beyond their heads: to read one whole would take minutes and more memory than a task has."""
    for i in range(16):
        with open(tmp_path / f"{i:02}.jpg", "wb") as f:
            f.write(bytes([i]) * 2000)
            f.truncate(10 << 30)
    (tmp_path / "empty.jpg").touch()
    (tmp_path / "other.txt").write_text("text")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "in.jpg").write_bytes(b"xyz")
    rows = prefixes.read_prefixes(spark, str(tmp_path), 1000, glob="*.jpg", files=5)
    assert rows.rdd.getNumPartitions() == 4
    found = {r.path.rsplit("/", 1)[1]: r for r in rows.collect()}
    assert len(found) == 17 and all(r.status == "completed" for r in found.values())
    assert all(bytes(found[f"{i:02}.jpg"].prefix) == bytes([i]) * 1000 and found[f"{i:02}.jpg"].length == 10 << 30 for i in range(16))
    assert bytes(found["empty.jpg"].prefix) == b""
    assert sum(len(r.prefix) for r in found.values()) == 16_000
    assert {r.path.rsplit("/", 1)[1]: bytes(r.prefix) for r in prefixes.read_prefixes(spark, f"file://{tmp_path}", 2, "*.jpg", recursive=True).collect()}["in.jpg"] == b"xy"
    one = prefixes.read_prefixes(spark, f"{tmp_path}/other.txt", 3).collect()
    assert [(bytes(r.prefix), r.length) for r in one] == [(b"tex", 4)]
    assert prefixes.read_prefixes(spark, str(tmp_path), 5, glob="*.none").count() == 0
    with pytest.raises(Exception, match="gone"):
        prefixes.read_prefixes(spark, f"{tmp_path}/gone", 5).collect()
