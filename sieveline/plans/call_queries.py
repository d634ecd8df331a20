"""Queries of tool calls, client attempts and cancelled runs, over parts and events."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calls
from ..session import table
from ..streaming import cancel

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


#: Calls of parts: the form turns with the key, keys and blanks of objects are in disorder, and numbers are written in several ways.
CALLS = """SELECT p_partkey, p_partkey % 5 AS turn, concat('/img/', p_name, '.png') AS image, p_size AS size, concat('print(', CAST(p_size AS {text}), ')') AS code FROM {table}"""
CALL_TEXT = """CASE turn WHEN 0 THEN concat('{"args":["', image, '"]}')
 WHEN 1 THEN concat('{"args":["{ \\\\"zoom\\\\": {\\\\"y\\\\": ', size, '.0, \\\\"x\\\\":[1, 2.50]}, \\\\"image_path\\\\" :\\\\"', image, '\\\\", \\\\"deep\\\\": null}"]}')
 WHEN 2 THEN concat('{"kwargs":{"scale":', size, '.50,"quality":7},"args":["', image, '", ', size, ']}')
 WHEN 3 THEN concat('{"args":["', code, '"],"kwargs":{"image_path":"', image, '"}}')
 ELSE concat('{"args":["image_path = ''', image, ''' ; ', code, '"]}') END"""
FORM = "CASE turn WHEN 0 THEN 'string' WHEN 1 THEN 'json' WHEN 2 THEN 'structured' ELSE 'code' END"


@query(f"""WITH c AS ({CALLS.format(text='VARCHAR', table='part')}), p AS (SELECT *, CASE turn WHEN 1 THEN concat('{{"deep":null,"zoom":{{"x":[1,2.5],"y":', size, '}}}}')
 WHEN 2 THEN concat('{{"quality":', size, ',"scale":', size, '.5}}') WHEN 3 THEN concat('{{"code":"', sha256(code), '"}}')
 WHEN 4 THEN concat('{{"code":"', sha256(concat('image_path = ''', image, ''' ; ', code)), '"}}') END AS params FROM c)
SELECT p_partkey, image, params, concat('tool_', substr(sha256(concat('{{"image_hash":"', sha256(image), '"', coalesce(',"params":' || params, ''), ',"tool":"tool"}}')), 1, 16), '.json') AS key FROM p""")
def fn52_call_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image, parameters and cache key of calls of every form."""
    rows = spark.sql(CALLS.format(text="STRING", table="{part}"), part=table(spark, sf_dir, "part")).selectExpr("p_partkey", f"{FORM} AS form", f"{CALL_TEXT} AS call")
    image, params = calls.call_parts(F.col("form"), F.col("call"))
    found = rows.select("p_partkey", image.alias("image"), params.alias("params"))
    return found.withColumn("key", calls.call_key(F.lit("tool"), F.sha2("image", 256), F.col("params")))


def failing(every: int):  # noqa: ANN201
    """A client that can't answer keys which ``every`` divides."""

    def factory():  # noqa: ANN202
        def call(key: int) -> str:
            if key % every == 0:
                raise ValueError(f"{key} by {every}")
            return str(key // every)

        return call

    return factory


CLIENTS = (calls.Client("a", failing(2), calls.Retry(1, 200)), calls.Client("b", failing(3), calls.Retry(2, 300, 1.5, 400)), calls.Client("c", failing(5)))
_start = "('0x' || substr(sha256(p_partkey::VARCHAR), 1, 8))::BIGINT % 3"
_clients = "(VALUES (0, 'a', 2, 2), (1, 'b', 3, 3), (2, 'c', 5, 1)) c(nth, client, every, tries)"


def _policy(start: str) -> str:
    return f"""WITH s AS (SELECT p_partkey, (nth - {start} + 3) % 3 AS place, client, every, tries, p_partkey % every <> 0 AS answers FROM part, {_clients}),
f AS (SELECT p_partkey, min(CASE WHEN answers THEN place END) AS first FROM s GROUP BY p_partkey)
SELECT p_partkey, max(CASE WHEN place = first THEN client END) AS client, sum(CASE WHEN first IS NULL OR place < first THEN tries WHEN place = first THEN 1 ELSE 0 END)::BIGINT AS attempts,
  CASE WHEN first IS NULL THEN 'error' ELSE 'completed' END AS status, max(CASE WHEN place = first THEN (p_partkey // every)::VARCHAR END) AS output,
  CASE WHEN first IS NULL THEN max(CASE WHEN place = 2 THEN concat(p_partkey, ' by ', every) END) END AS error FROM s JOIN f USING (p_partkey) GROUP BY p_partkey, first"""


def _outcomes(spark: SparkSession, sf_dir: str, round_robin: bool) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey")
    return calls.attempted(parts, "p_partkey", ["p_partkey"], CLIENTS, round_robin, sleep=lambda _: None)[1]


@query(_policy("0"))
def ud12_fallback_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir, False)


@query(_policy(f"({_start})"))
def ud12_round_robin_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir, True)


RUN_EVENTS = """SELECT concat('u', CAST(user_id % 40 AS {text})) AS run, concat('c', CAST(event_id % 97 AS {text})) AS cell, ts,
 CASE WHEN event_type = 'error' AND event_id % 50 = 0 THEN 'cancel' WHEN event_type IN ('click', 'purchase') THEN 'done' ELSE 'open' END AS kind,
 CASE event_type WHEN 'click' THEN 'fake' WHEN 'purchase' THEN 'real' END AS prediction FROM {table}"""


@query(f"""WITH e AS ({RUN_EVENTS.format(text='VARCHAR', table='events')}), g AS (SELECT *, lead(ts) OVER (PARTITION BY run ORDER BY ts) AS after, max(ts) OVER () AS upto FROM e WHERE run IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT run, least(min(CASE WHEN coalesce(after, upto) > ts + INTERVAL 12 HOUR THEN ts + INTERVAL 12 HOUR END), min(CASE WHEN kind = 'cancel' THEN ts END)) AS stop FROM g GROUP BY run),
c AS (SELECT run, cell, min(ts) AS first, min(CASE WHEN kind = 'done' THEN ts END) AS done, arg_min(prediction, ts) FILTER (kind = 'done') AS said FROM g WHERE kind <> 'cancel' GROUP BY run, cell),
r AS (SELECT *, done IS NOT NULL AND (stop IS NULL OR done <= stop) AS reached FROM c JOIN s USING (run))
SELECT run, cell, CASE WHEN reached THEN 'completed' ELSE 'cancelled' END AS status, epoch_us(CASE WHEN reached THEN done ELSE greatest(stop, first) END) AS at_micros,
  CASE WHEN reached THEN said ELSE 'uncertain' END AS prediction, CASE WHEN NOT reached THEN 'cancelled' END AS error, CASE WHEN NOT reached THEN 'cancelled' END AS error_type FROM r WHERE reached OR stop IS NOT NULL""")
def str03_cancelled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of users' runs, stopped by an error of some events or by twelve quiet hours."""
    rows = spark.sql(RUN_EVENTS.format(text="STRING", table="{events}"), events=table(spark, sf_dir, "events"))
    found = cancel.stopped(rows, timedelta(hours=12))
    return found.withColumn("at_micros", F.unix_micros("at")).drop("at")
