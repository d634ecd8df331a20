"""Queries of record, tool-run and answer functions, each with its oracle where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import results, text
from ..operators import external
from ..session import table
from .bridge import oracle, records
from .text_queries import _count

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def with_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose tools ran as their details say, each answering with its seconds."""
    state = F.when(F.col("event_id") % 5 == 0, "error").otherwise("completed")
    runs = F.transform(
        F.concat("tool_details", F.slice("tool_details", 1, 1)),
        lambda d: F.struct(d["tool"].alias("tool"), d["seconds"].alias("seconds"), state.alias("status"), F.lit(None).cast("string").alias("error"), F.concat(F.lit('{"k":'), F.col("k"), F.lit("}")).alias("parsed")),
    )
    return records(spark, sf_dir).withColumn("tool_results", runs)


@query(oracle("SELECT CAST(event_id AS VARCHAR) AS id, model, label, coalesce(prediction, 'unknown') AS prediction, use_tools, trial, round(confidence, 8) AS confidence, prediction IS NOT DISTINCT FROM label AS is_correct, len(tool_usage)::INT AS tool_count, latency_seconds FROM records"))
def fn38_result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.summary_row(records(spark, sf_dir).withColumn("id", F.col("event_id").cast("string"))).withColumn("confidence", F.round("confidence", 8))


RUNS = "x AS (SELECT *, tool_details || tool_details[1:1] AS runs, CASE WHEN event_id % 5 = 0 THEN 'error' ELSE 'completed' END AS status FROM records)"


@query(oracle("SELECT event_id, d.tool AS name, status, round(d.seconds, 8) AS seconds FROM (SELECT event_id, status, unnest(runs) AS d FROM x)", RUNS))
def fn39_tool_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_runs(spark, sf_dir).select("event_id", F.explode(results.tool_info(F.col("tool_results"))).alias("t"))
    return rows.select("event_id", "t.name", "t.status", F.round("t.seconds", 8).alias("seconds"))


@query(
    oracle(
        "SELECT event_id, tool, count(*) AS runs, status, round(arg_max(seconds, pos), 8) AS seconds, concat('{\"k\":', k, '}') AS parsed FROM (SELECT event_id, status, k, d.tool AS tool, d.seconds AS seconds, pos FROM (SELECT event_id, status, k, unnest(runs) AS d, unnest(range(len(runs))) AS pos FROM x)) GROUP BY event_id, tool, status, k",
        RUNS,
    )
)
def ag29_tool_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.tool_states(with_runs(spark, sf_dir), ["event_id"]).withColumn("seconds", F.round("seconds", 8))


@query(oracle("SELECT event_id, lower(coalesce(prediction, '')) = lower(label) AS is_right, CASE prediction WHEN 'fake' THEN 'red' WHEN 'real' THEN 'green' ELSE 'grey' END AS colour FROM records"))
def fn42_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    right, colour = results.badge(F.upper("prediction"), F.col("label"))
    return records(spark, sf_dir).select("event_id", right.alias("is_right"), colour.alias("colour"))


@query("SELECT event_id, value / 100 AS value, CASE WHEN value / 100 > CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 2.0 END THEN 'red' ELSE 'green' END AS colour FROM events")
def fn43_tool_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("event_id") % 2 == 0
    number = (F.col("value") / 100).cast("string")
    parsed = F.concat(F.lit('{"'), F.when(even, "manipulation_probability").otherwise("ela_anomaly_score"), F.lit('": '), number, F.lit("}"))
    value, colour = results.display(F.when(even, "perform_trufor").otherwise("perform_ela"), parsed)
    return table(spark, sf_dir, "events").select("event_id", value.alias("value"), colour.alias("colour"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'fake' WHEN 'view' THEN 'real' ELSE 'uncertain' END AS verdict, round(least(1.0, value / 100), 8) AS confidence, event_type AS description FROM events")
def fn21_built_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("event_type") == "click", "AI-Generated").when(F.col("event_type") == "view", "Authentic.").otherwise("who knows")
    said = F.to_json(F.struct(verdict.alias("verdict"), (F.col("value") / 100).alias("confidence"), F.col("event_type").alias("visual_summary")))
    r = results.built_result(F.concat(F.lit("answer: "), said))
    rows = table(spark, sf_dir, "events").select("event_id", r.alias("r"))
    return rows.select("event_id", "r.verdict", F.round("r.confidence", 8).alias("confidence"), F.col("r.visual_description").alias("description"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'fake' WHEN 1 THEN 'real' WHEN 2 THEN 'inconclusive' END AS verdict FROM events")
def fn20_answer_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ('{"verdict": "fake", "x": 1}', 'a {"confidence": 1} b {"verdict": "real"} c {"note": 2}', "**Verdict**: Inconclusive", "nothing at all")
    said = F.regexp_replace(F.get(F.array(*map(F.lit, forms)), (F.col("event_id") % 4).cast("int")), r"\*\*", "")
    rows = table(spark, sf_dir, "events").select("event_id", said.alias("said")).withColumn("spans", text.json_spans("said"))
    return rows.select("event_id", F.get_json_object(results.answer_payload(F.col("said"), F.col("spans")), "$.verdict").alias("verdict"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('- perform_ela: status=completed, anomaly_score=', printf('%.3f', value), ', quality=', (event_id % 100)::VARCHAR) WHEN 1 THEN '- other: status=unknown' ELSE '- perform_ela: status=unparsed' END AS line FROM events")
def fn22_summary_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("event_id") % 3
    raw = F.when(turn == 0, F.concat(F.lit('{"status": "completed", "ela_anomaly_score": '), F.col("value").cast("string"), F.lit(', "quality": '), (F.col("event_id") % 100).cast("string"), F.lit("}"))).when(turn == 1, "{}").otherwise("broken")
    return table(spark, sf_dir, "events").select("event_id", results.summary_line(F.when(turn == 1, "other").otherwise("perform_ela"), raw).alias("line"))


@query(oracle("SELECT event_id, (list_contains(tool_usage, 'ela')::INT + list_contains(tool_usage, 'detector')::INT)::INT AS caveats FROM records"))
def se05_caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.transform("tool_usage", lambda t: F.when(t == "ela", "perform_ela").when(t == "detector", "perform_trufor").otherwise(t))
    return records(spark, sf_dir).select("event_id", F.size(results.caveats(F.concat(known, known))).alias("caveats"))


_answer = "lower(coalesce(text, '') || CASE conv_id % 5 WHEN 0 THEN ' Verdict: FAKE, confidence: 0.9' WHEN 1 THEN ' it looks genuine, 70%' WHEN 2 THEN ' synthetic, not real' WHEN 3 THEN ' authentic or tampered: 12 %' ELSE '' END)"


@query(
    "SELECT conv_id, turn, CASE WHEN stated <> '' THEN stated WHEN fake > \"real\" THEN 'fake' WHEN \"real\" > fake THEN 'real' ELSE 'uncertain' END AS verdict, "
    "CASE WHEN s <> '' THEN CAST(s AS DOUBLE) WHEN p <> '' THEN least(1.0, CAST(p AS DOUBLE) / 100) ELSE 0.5 END::DOUBLE AS confidence FROM ("
    f"SELECT conv_id, turn, regexp_extract(t, 'verdict\\s*:\\s*(fake|real|uncertain)', 1) AS stated, {_count(text.FAKE_PATTERNS)} AS fake, {_count(text.REAL_PATTERNS)} AS \"real\", "
    f"regexp_extract(t, 'confidence[:\\s]+([0-9.]+)', 1) AS s, regexp_extract(t, '(\\d+(?:\\.\\d+)?)\\s*%', 1) AS p FROM (SELECT conv_id, turn, {_answer} AS t FROM conversations))"
)
def ud09_structured_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations with answers of five kinds at their ends."""
    turn = F.col("conv_id") % 5
    ends = (" Verdict: FAKE, confidence: 0.9", " it looks genuine, 70%", " synthetic, not real", " authentic or tampered: 12 %", "")
    said = F.concat(F.coalesce("text", F.lit("")), F.get(F.array(*map(F.lit, ends)), turn.cast("int")))
    return external.pluggable_verdicts(table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("text")), ["conv_id", "turn"], "text")
