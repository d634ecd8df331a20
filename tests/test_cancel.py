import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sieveline.streaming import cancel

WAIT = timedelta(hours=2)
SCHEMA = "run string, cell string, kind string, ts timestamp, prediction string"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def events(seed, n=400):
    rng = random.Random(seed)
    rows, at = [], START
    for _ in range(n):
        at += timedelta(seconds=rng.choice([1, 20, 200, 900]))
        if rng.random() < 0.02:
            at += timedelta(hours=3)
        kind = rng.choices(["open", "done", "cancel"], [5, 4, 0.1])[0]
        rows.append((f"r{rng.randrange(6)}", None if kind == "cancel" else f"c{rng.randrange(40)}", kind, at, rng.choice(["real", "fake", None]) if kind == "done" else None))
    return rows


def plain(rows, upto):
    """Events of a run one after the other."""
    out, order = [], {"open": 0, "done": 1, "cancel": 2}
    for run in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == run), key=lambda r: (r[3], order[r[2]], r[4] is not None, r[4] or ""))
        cells, stop, last = {}, None, None

        def close(at, run=run, cells=cells):
            for c in cells:
                if cells[c] is None:
                    cells[c] = (run, c, "cancelled", at, "uncertain", "cancelled", "cancelled")

        for _, cell, kind, ts, said in own:
            if stop is None and last is not None and ts > last + WAIT:
                stop = last + WAIT
                close(stop)
            last = ts
            if kind == "cancel":
                if stop is None:
                    stop = ts
                    close(stop)
            elif cells.get(cell) is None:
                cells[cell] = (run, cell, "cancelled", ts, "uncertain", "cancelled", "cancelled") if stop else (run, cell, "completed", ts, said, None, None) if kind == "done" else None
        if stop is None and upto > last + WAIT:
            close(last + WAIT)
        out += [c for c in cells.values() if c]
    return sorted(out, key=repr)


def utc(rows):
    return sorted(((*r[:3], r[3].replace(tzinfo=timezone.utc), *r[4:]) for r in rows), key=repr)


def found(df):
    at = F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return utc((*r[:3], datetime.strptime(r[3], "%Y-%m-%d %H:%M:%S.%f"), *r[4:]) for r in map(tuple, df.withColumn("at", at).select(*cancel.COLUMNS).collect()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_matches_one_event_after_the_other(spark, seed):
    rows = events(seed)
    odd = [(None, "c", "open", START, None), ("r1", None, "open", START, None), ("r1", "c", "other", START, None), ("r1", "c", "done", None, "x")]
    got = found(cancel.stopped(spark.createDataFrame(rows + odd, SCHEMA), WAIT))
    assert got == plain(rows, max(r[3] for r in rows))
    assert {r[2] for r in got} == {"completed", "cancelled"}


def test_edges(spark):
    at = lambda h: START + timedelta(hours=h)
    rows = [("a", "x", "open", at(0), None), ("a", None, "cancel", at(1), None), ("a", "y", "done", at(1), "real"), ("a", "x", "done", at(1.5), "fake"), ("a", "z", "open", at(1.5), None)]
    rows += [("b", "x", "open", at(0), None), ("b", "x", "done", at(2), "real"), ("c", "x", "open", at(0), None), ("c", "x", "done", at(2.1), "real"), ("d", "x", "open", at(2), None), ("e", None, "cancel", at(0), None)]
    got = {r[:4] for r in found(cancel.stopped(spark.createDataFrame(rows, SCHEMA), WAIT))}
    assert got == {("a", "x", "cancelled", at(1)), ("a", "y", "completed", at(1)), ("a", "z", "cancelled", at(1.5)), ("b", "x", "completed", at(2)), ("c", "x", "cancelled", at(2))}
    assert found(cancel.stopped(spark.createDataFrame([], SCHEMA), WAIT)) == []


def run_stream(spark, folder, out, checkpoint, shards):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(folder)
    query = cancel.stopped_stream(stream, WAIT, late="0 seconds", shards=shards).writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("shards", [1, 3])
def test_stream_equals_batch_also_after_a_restart(spark, tmp_path, shards):
    rows = events(5, 160)
    # the watermark of the last event but one decides on the silence of the rest
    end = max(r[3] for r in rows) + timedelta(hours=5)
    rows += [("end", "c", "open", end, None), ("end", "c", "done", end + timedelta(seconds=1), "real")]
    folder, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    parts = [rows[i : i + 41] for i in range(0, len(rows), 41)]
    half = len(parts) // 2
    for turn, some in enumerate((parts[:half], parts[half:])):
        for i, part in enumerate(some):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/{turn}{i}")
        run_stream(spark, f"{folder}/*", out, checkpoint, shards)
    got = found(spark.read.schema(cancel.RESULT).json(out))
    want = found(cancel.stopped(spark.createDataFrame(rows, SCHEMA), WAIT))
    assert got == want and len(got) == len({r[:2] for r in got})
    assert {r[2] for r in got} == {"completed", "cancelled"}
