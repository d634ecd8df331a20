"""Runs that stop: what they did not reach becomes a cancelled row, once, in a batch and in a stream alike.

Events say that a cell of a run was opened or done, or that a run is cancelled.
A run stops at its cancel event, or when nothing happened in it for longer than
``patience``. A cell that is done by then is completed; any other cell that the
run has or still gets is cancelled, at the stop or when it first shows up later.
Of equal times, cells are opened before they are done, and done before a cancel.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Kinds of events in the order that they take at one time, and words of a cancelled record.
OPENED, DONE, CANCEL = "open", "done", "cancel"
CANCELLED, UNCERTAIN = "cancelled", "uncertain"
COLUMNS = ["run", "cell", "status", "at", "prediction", "error", "error_type"]
RESULT = "run string, cell string, status string, at timestamp, prediction string, error string, error_type string"
#: Times inside the stream are microseconds.
INSIDE = RESULT.replace("at timestamp", "at long")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _row(status: Column, at: Column, prediction: Column) -> list[Column]:
    gone = F.when(status == CANCELLED, CANCELLED)
    return [status.alias("status"), at.alias("at"), F.when(status == CANCELLED, UNCERTAIN).otherwise(prediction).alias("prediction"), gone.alias("error"), gone.alias("error_type")]


def known_events(events: DataFrame) -> DataFrame:
    """Events that say something: of a run, at a time, of a known kind, and of a cell unless they cancel."""
    sound = (F.col("kind") == CANCEL) | (F.col("kind").isin(OPENED, DONE) & F.col("cell").isNotNull())
    return events.select("run", "cell", "kind", F.col("ts").cast("timestamp").alias("ts"), "prediction").filter(F.col("run").isNotNull() & F.col("ts").isNotNull() & sound)


def stops(events: DataFrame, patience: timedelta, upto: Column) -> DataFrame:
    """run and stop (null if it goes on) of each run; ``upto`` is the time that has come, by which silence is judged.

    A silence can't lie within a stretch as long as the patience. So events come
    down to a row a stretch, by counts that combine map-side, and only those are
    put in order, however many events a run has.
    """
    wait = patience // timedelta(microseconds=1)
    micros = F.unix_micros("ts")
    cancelled = F.min(F.when(F.col("kind") == CANCEL, micros)).alias("cancelled")
    stretches = events.groupBy("run", F.floor(micros / wait).alias("stretch")).agg(F.min(micros).alias("first"), F.max(micros).alias("last"), cancelled)
    after = F.lead("first").over(Window.partitionBy("run").orderBy("stretch"))
    quiet = F.when(F.coalesce(after, F.greatest(F.unix_micros(upto), F.col("last"))) > F.col("last") + wait, F.col("last") + wait)
    return stretches.select("run", F.least(quiet, "cancelled").alias("stop")).groupBy("run").agg(F.timestamp_micros(F.min("stop")).alias("stop"))


def stopped(events: DataFrame, patience: timedelta, upto: Column | None = None) -> DataFrame:
    """COLUMNS of every cell that is completed or cancelled.

    Events are run, cell, kind, ts and prediction; a cancel has no cell. Events
    without a run, a time or a known kind say nothing, and so does a cell event
    without a cell. ``upto`` defaults to the latest time of all events. Repeated
    events count once, the earliest; of several outcomes at one time, the least.
    """
    known = known_events(events)
    if upto is None:
        upto = F.lit(known.agg(F.max("ts")).first()[0])
    ended = stops(known, patience, upto)
    done = F.col("kind") == DONE
    cells = known.filter(F.col("kind") != CANCEL).groupBy("run", "cell").agg(
        F.min("ts").alias("first"), F.min(F.when(done, F.struct("ts", "prediction"))).alias("done")
    )
    both = cells.join(ended, "run")
    reached = F.col("done.ts").isNotNull() & (F.col("stop").isNull() | (F.col("done.ts") <= F.col("stop")))
    status = F.when(reached, "completed").when(F.col("stop").isNotNull(), CANCELLED)
    at = F.when(reached, F.col("done.ts")).otherwise(F.greatest("stop", "first"))
    return both.filter(status.isNotNull()).select("run", "cell", *_row(status, at, F.col("done.prediction")))


class Cells(StatefulProcessor):
    """Cells of one shard of a run: what is known of each, the last time anything happened, and the stop."""

    def __init__(self, patience: int) -> None:
        self.patience = patience  # in microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "cell string", "settled boolean")
        self.run = handle.getValueState("run", "last long, stop long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        order = {OPENED: 0, DONE: 1, CANCEL: 2}
        last, stop = self.run.get() if self.run.exists() else (None, None)
        for row in sorted(rows, key=lambda r: (r.micros, order[r.kind], r.prediction is not None, r.prediction or "")):
            if stop is None and last is not None and row.micros > last + self.patience:
                stop = last + self.patience
                yield from self.closed(key, stop)
            last = row.micros if last is None else max(last, row.micros)
            if row.kind == CANCEL:
                if stop is None:
                    stop = row.micros
                    yield from self.closed(key, stop)
            elif row.cell is not None and not (self.cells.containsKey((row.cell,)) and self.cells.getValue((row.cell,))[0]):
                settled = stop is not None or row.kind == DONE
                if settled:
                    yield self.result(key, row.cell, row.micros, None if stop is not None else row.prediction, stop is not None)
                self.cells.updateValue((row.cell,), (settled,))
        self.run.update((last, stop))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if stop is None and last is not None:
            self.handle.registerTimer((last + self.patience) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        last, stop = self.run.get()
        if stop is None:
            self.run.update((last, last + self.patience))
            yield from self.closed(key, last + self.patience)

    def closed(self, key, stop) -> Iterator[Row]:  # noqa: ANN001
        """Every cell that is still open, as cancelled; it is settled by that."""
        for (cell,), (settled,) in list(self.cells.iterator()):
            if not settled:
                self.cells.updateValue((cell,), (True,))
                yield self.result(key, cell, stop, None, True)

    def result(self, key, cell, at, prediction, gone: bool) -> Row:  # noqa: ANN001
        word = CANCELLED if gone else None
        return Row(run=key[0], cell=cell, status=word or "completed", at=at, prediction=UNCERTAIN if gone else prediction, error=word, error_type=word)

    def close(self) -> None:
        pass


def stopped_stream(events: DataFrame, patience: timedelta, late: str = "1 hour", shards: int = 4) -> DataFrame:
    """``stopped`` for a stream: rows appear as cells are done, runs are cancelled, or the watermark passes their silence.

    State is by run and shard, so a run of any number of cells is spread over
    tasks; what all shards of a run must see, a cancel and that the run is alive,
    goes to each of them, so a shard more is a small row more an event. Rows come in the order of event time from one trigger
    to the next; within a trigger they are put in order. Sets the session's state
    store to one that holds maps and timers.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    own = F.pmod(F.xxhash64("cell"), F.lit(shards)).cast("int") == F.col("shard")
    dealt = known_events(events).withWatermark("ts", late).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    alive = (F.col("kind") != CANCEL) & ~own
    dealt = dealt.select("run", "shard", F.when(~alive, F.col("cell")).alias("cell"), F.when(alive, OPENED).otherwise(F.col("kind")).alias("kind"), "ts", F.unix_micros("ts").alias("micros"), "prediction")
    rows = dealt.groupBy("run", "shard").transformWithState(Cells(patience // timedelta(microseconds=1)), outputStructType=INSIDE, outputMode="Append", timeMode="EventTime")
    return rows.withColumn("at", F.timestamp_micros("at"))
