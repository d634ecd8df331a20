"""Streams of evaluation records: running metrics, cancelled runs, windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.inference import ratio
from ..operators.metrics import abstained, failed, running_metrics


def result_stream(spark: SparkSession, folder: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """Result files of a folder as they arrive, in no order that matters."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(folder)


def running(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Running metrics of all records so far, in a table in memory of that name; ends when the folder is read."""
    query = running_metrics(stream).writeStream.outputMode("complete").format("memory").queryName(name)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(stream: DataFrame, late: str) -> DataFrame:
    """The stream with its event time, which may come without a zone, under a watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def daily(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Accuracy and coverage of each model in windows of event time; records later than the watermark are dropped."""
    said = ~failed() & ~abstained()
    right = said & F.col("prediction").eqNullSafe(F.col("label"))
    counted = _timed(stream, late).groupBy(F.window("ts", width), "model").agg(
        F.count("*").alias("n"), F.count_if(said).alias("answered"), F.count_if(right).alias("correct")
    )
    rates = {"accuracy": ratio(F.col("correct"), F.col("n")), "coverage": ratio(F.col("answered"), F.col("n"))}
    return counted.select(F.col("window.start").alias("start"), "model", "n", "answered", "correct").withColumns(rates)


def distinct_records(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each record once, however often it arrives within the watermark."""
    return _timed(stream, late).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, who: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of work by person: records that follow one another within the gap."""
    counted = _timed(stream, late).groupBy(F.session_window("ts", gap), who).agg(F.count("*").alias("n"))
    return counted.select(who, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def cancelled(grid: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Records of a stopped run with what it did not reach, as cancelled."""
    missing = grid.join(records, keys, "left_anti").withColumn("error_type", F.lit("cancelled")).withColumn("error", F.lit("cancelled"))
    return records.unionByName(missing, allowMissingColumns=True)
