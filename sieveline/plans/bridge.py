"""Evaluation records: the engine's fact table, and its derivation from the events table.

A record says what one model, with or without tools, answered for one sample.
``records`` derives records from events, ten consecutive ids a sample that five
models judge in two modes, so that every operator can run on any scale.
``RECORDS_SQL`` is the same derivation in DuckDB, as the first CTE of an oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

TOOLS = ("metadata", "detector", "ela", "residuals")
PREDICTION = "CASE event_type WHEN 'click' THEN 'fake' WHEN 'purchase' THEN 'real' WHEN 'view' THEN 'uncertain' WHEN 'error' THEN 'uncertain' END"
SAMPLE = "CAST(floor(event_id / 10.0) AS BIGINT)"
LABEL = f"CASE WHEN ({SAMPLE} * 7 + 3) % 10 < 5 THEN 'fake' ELSE 'real' END"
USE_TOOLS = "CAST(floor(event_id / 5.0) AS BIGINT) % 2 = 0"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record an event; columns of the fact table that the operators read."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", "props")
    base = events.selectExpr(
        "event_id", "ts", f"{SAMPLE} AS sample_id", "concat('m', CAST(event_id % 5 AS STRING)) AS model", f"{USE_TOOLS} AS use_tools",
        f"CAST({SAMPLE} % 3 AS INT) AS trial", f"{LABEL} AS label", f"{PREDICTION} AS prediction",
        "CASE WHEN event_type = 'error' THEN 'exception' END AS error", "value / 100.0D AS raw_confidence",
        "least(greatest(value / 100.0D, 0.0D), 1.0D) AS confidence", "value AS latency_seconds",
        "coalesce(try_cast(get_json_object(props, '$.k') AS INT), 0) AS k",
        "CASE WHEN event_id % 7 <> 0 THEN concat('v', CAST(event_id % 3 AS STRING)) END AS vision_model",
    )
    used = [F.when(F.col("use_tools") & (F.col("k").bitwiseAND(1 << i) > 0), F.lit(name)) for i, name in enumerate(TOOLS)]
    seconds = [
        F.when(F.col("use_tools") & (F.col("k").bitwiseAND(1 << i) > 0), F.struct(F.lit(name).alias("tool"), (F.col("latency_seconds") * (i + 1) / 100).alias("seconds")))
        for i, name in enumerate(TOOLS)
    ]
    return base.withColumns({"tool_usage": F.array_compact(F.array(*used)), "tool_details": F.array_compact(F.array(*seconds))})


_used = ", ".join(f"CASE WHEN use_tools AND k & {1 << i} > 0 THEN '{name}' END" for i, name in enumerate(TOOLS))
_seconds = ", ".join(f"CASE WHEN use_tools AND k & {1 << i} > 0 THEN {{'tool': '{name}', 'seconds': latency_seconds * {i + 1} / 100}} END" for i, name in enumerate(TOOLS))
RECORDS_SQL = f"""base AS (SELECT event_id, ts, {SAMPLE} AS sample_id, concat('m', CAST(event_id % 5 AS VARCHAR)) AS model, {USE_TOOLS} AS use_tools,
  CAST({SAMPLE} % 3 AS INT) AS trial, {LABEL} AS label, {PREDICTION} AS prediction,
  CASE WHEN event_type = 'error' THEN 'exception' END AS error, value / 100.0::DOUBLE AS raw_confidence,
  least(greatest(value / 100.0::DOUBLE, 0.0), 1.0)::DOUBLE AS confidence, value AS latency_seconds,
  coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), 0) AS k,
  CASE WHEN event_id % 7 <> 0 THEN concat('v', CAST(event_id % 3 AS VARCHAR)) END AS vision_model FROM events),
records AS (SELECT *, list_filter([{_used}], lambda x: x IS NOT NULL) AS tool_usage,
  list_filter([{_seconds}], lambda x: x IS NOT NULL) AS tool_details FROM base)"""


def oracle(body: str, *ctes: str) -> str:
    """An oracle over the records CTE, further CTEs and a final SELECT."""
    return f"WITH {', '.join((RECORDS_SQL, *ctes))} {body}"
