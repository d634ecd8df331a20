"""Queries over evaluation records: metrics, calibration, comparisons and rankings, each with its oracle."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import inference
from ..operators import comparison, distribution, metrics, ranking
from . import report
from .bridge import oracle, records

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Double columns rounded, so that the order of sums doesn't show."""
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


FAILED = "coalesce(error, '') <> ''"
ABSTAINED = f"NOT ({FAILED}) AND (prediction IS NULL OR prediction = 'uncertain')"
ANSWERED = f"NOT ({FAILED}) AND coalesce(prediction IN ('real', 'fake'), false)"
_seconds = "list_sum([0.0] || list_transform(tool_details, lambda d: coalesce(d.seconds, 0)))"
_parts = f"""count(*) AS total,
  count(*) FILTER ({ANSWERED} AND label = 'fake' AND prediction = 'fake') AS tp, count(*) FILTER ({ANSWERED} AND label = 'real' AND prediction = 'real') AS tn,
  count(*) FILTER ({ANSWERED} AND label = 'real' AND prediction = 'fake') AS fp, count(*) FILTER ({ANSWERED} AND label = 'fake' AND prediction = 'real') AS fn,
  count(*) FILTER ({FAILED}) AS error_count, count(*) FILTER ({ABSTAINED}) AS abstain_count,
  count(*) FILTER ({ABSTAINED} AND label = 'fake') AS abstain_count_fake, count(*) FILTER ({ABSTAINED} AND label = 'real') AS abstain_count_real,
  count(*) FILTER (label = 'fake') AS support_fake, count(*) FILTER (label = 'real') AS support_real,
  coalesce(avg(coalesce(confidence, 0)) FILTER ({ANSWERED}), 0) AS avg_confidence, coalesce(avg(latency_seconds) FILTER ({ANSWERED}), 0) AS avg_latency_seconds,
  coalesce(avg(len(tool_usage)) FILTER ({ANSWERED}), 0) AS avg_tool_count,
  coalesce(avg({_seconds}) FILTER ({ANSWERED} AND {_seconds} > 0), 0) AS avg_tool_seconds_total"""


def _div(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0)"


_first = f"""*, tp + tn AS correct, total - error_count - abstain_count AS answered, {_div("tp", "tp + fp")} AS precision_fake, {_div("tp", "tp + fn")} AS recall_fake,
  {_div("tn", "tn + fn")} AS precision_real, {_div("tn", "tn + fp")} AS recall_real"""
_second = f"""*, {_div("correct", "total")} AS accuracy, {_div("correct", "greatest(answered, 0)")} AS accuracy_answered, {_div("answered", "total")} AS coverage,
  {_div("2 * precision_fake * recall_fake", "precision_fake + recall_fake")} AS f1_fake, {_div("2 * precision_real * recall_real", "precision_real + recall_real")} AS f1_real,
  (recall_fake + recall_real) / 2 AS balanced_accuracy, {_div("abstain_count", "total")} AS abstain_rate, {_div("abstain_count_fake", "support_fake")} AS abstain_rate_fake,
  {_div("abstain_count_real", "support_real")} AS abstain_rate_real, {_div("error_count", "total")} AS error_rate,
  {_div("greatest(support_fake - abstain_count_fake, 0)", "support_fake")} AS coverage_fake, {_div("greatest(support_real - abstain_count_real, 0)", "support_real")} AS coverage_real,
  {_div("fn", "support_fake")} AS fake_slip_rate, {_div("fp", "support_real")} AS real_false_flag_rate, {_div("tp", "support_fake")} AS fake_catch_rate, {_div("tn", "support_real")} AS real_pass_rate"""
_alike = ", ".join(f"{c} AS {c}_answered" for c in ("balanced_accuracy", "precision_fake", "recall_fake", "f1_fake", "precision_real", "recall_real", "f1_real"))


def metric_ctes(by: str = "model, use_tools", source: str = "records", name: str = "m") -> tuple[str, ...]:
    return (
        f"{name}0 AS (SELECT {by}, {_parts} FROM {source} GROUP BY {by})", f"{name}1 AS (SELECT {_first} FROM {name}0)",
        f"{name}2 AS (SELECT {_second} FROM {name}1)", f"{name} AS (SELECT *, {_alike} FROM {name}2)",
    )


COUNTS = ("total", "tp", "tn", "fp", "fn", "error_count", "abstain_count", "abstain_count_fake", "abstain_count_real", "support_fake", "support_real", "correct", "answered")
RATES = (
    *metrics.HEADLINE, "error_rate", "avg_confidence", "avg_latency_seconds", "avg_tool_count", "avg_tool_seconds_total",
    "precision_fake_answered", "recall_fake_answered", "f1_fake_answered", "precision_real_answered", "recall_real_answered", "f1_real_answered",
)
_shown = ", ".join([*COUNTS, *(f"round({c}, 8) AS {c}" for c in RATES)])


@query(oracle(f"SELECT model, use_tools, {_shown} FROM m", *metric_ctes()))
def ag01_confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.compute_metrics(records(spark, sf_dir)).select("model", "use_tools", *COUNTS, *RATES))


@query(oracle(f"SELECT model, use_tools, trial, {_shown} FROM m", *metric_ctes("model, use_tools, trial")))
def ag07_metrics_by_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.metrics_by_trial(records(spark, sf_dir)).select("model", "use_tools", "trial", *COUNTS, *RATES))


_usage = "CAST(k * 3 AS BIGINT) AS prompt_tokens, CAST(k * 2 AS BIGINT) AS completion_tokens, CAST(k * 5 AS BIGINT) AS total_tokens"


@query(
    oracle(
        "SELECT model, coalesce(sum(prompt_tokens), 0)::BIGINT AS sum_prompt_tokens, coalesce(sum(completion_tokens), 0)::BIGINT AS sum_completion_tokens, "
        "coalesce(sum(total_tokens), 0)::BIGINT AS sum_total_tokens, round(avg(prompt_tokens), 8) AS avg_prompt_tokens, round(avg(completion_tokens), 8) AS avg_completion_tokens, "
        f"round(avg(total_tokens), 8) AS avg_total_tokens, count(total_tokens) AS with_tokens FROM (SELECT model, {_usage} FROM records) GROUP BY model"
    )
)
def ag02_token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.token_metrics(records(spark, sf_dir).selectExpr("model", *(p.strip() for p in _usage.split(", "))))


@query(
    oracle(
        f"SELECT model, use_tools, CASE WHEN {FAILED} THEN 'error' WHEN {ABSTAINED} THEN 'abstain' ELSE 'answered' END AS bucket, count(*) AS n, "
        "count(*) FILTER (label = 'fake') AS fake, count(*) FILTER (label = 'real') AS \"real\" FROM records GROUP BY ALL"
    )
)
def ag03_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).withColumn("bucket", metrics.bucket())
    return rows.groupBy("model", "use_tools", "bucket").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "fake").alias("fake"), F.count_if(F.col("label") == "real").alias("real"))


_right = f"NOT ({FAILED}) AND NOT ({ABSTAINED}) AND prediction IS NOT DISTINCT FROM label"
_running = f"""SELECT model, use_tools, count(*) AS n, count(*) FILTER ({_right}) AS correct,
  count(*) FILTER (NOT ({FAILED}) AND NOT ({ABSTAINED}) AND prediction IS DISTINCT FROM label) AS wrong, count(*) FILTER ({ABSTAINED}) AS uncertain,
  count(*) FILTER ({FAILED}) AS errors FROM records GROUP BY model, use_tools"""


@query(oracle(f"SELECT *, round({_div('correct', 'correct + wrong')}, 8) AS acc FROM r", f"r AS ({_running})"))
def ag04_running_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.running_metrics(records(spark, sf_dir)))


_long = " UNION ALL ".join(f"SELECT model, use_tools, '{c}' AS metric, {c} AS value FROM m" for c in metrics.HEADLINE)


@query(
    oracle(
        "SELECT model, use_tools, metric, round(avg(value), 8) AS mean, round(coalesce(stddev_samp(value), 0), 8) AS std, count(*) AS trials FROM l GROUP BY ALL",
        *metric_ctes("model, use_tools, trial"), f"l AS ({_long})",
    )
)
def ag05_trial_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.trial_summary(metrics.metrics_by_trial(records(spark, sf_dir)))


@query(
    oracle(
        "SELECT model, use_tools, round(avg(total), 8) AS avg_total, round(avg(support_fake), 8) AS avg_support_fake, round(avg(support_real), 8) AS avg_support_real, "
        "round(avg(error_rate), 8) AS mean_error_rate, round(avg(abstain_rate), 8) AS mean_abstain_rate FROM m GROUP BY ALL",
        *metric_ctes("model, use_tools, trial"),
    )
)
def ag06_trial_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.trial_totals(metrics.metrics_by_trial(records(spark, sf_dir)))


_mcc = "coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)"


@query(
    oracle(
        f"SELECT model, use_tools, round({_mcc}, 8) AS mcc, printf('MCC = (%d*%d - %d*%d) / sqrt(%d*%d*%d*%d) = %.4f', tp, tn, fp, fn, tp + fp, tp + fn, tn + fp, tn + fn, {_mcc}) AS said FROM m",
        *metric_ctes(),
    )
)
def ag09_mcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.compute_metrics(records(spark, sf_dir))
    cells = [F.col(c) for c in ("tp", "tn", "fp", "fn")]
    return found.select("model", "use_tools", F.round(inference.mcc(*cells), 8).alias("mcc"), inference.mcc_explained(*cells).alias("said"))


_wilson = "(accuracy + 1.96*1.96/(2*total)) / (1 + 1.96*1.96/total)", "1.96 * sqrt(accuracy*(1-accuracy)/total + 1.96*1.96/(4.0*total*total)) / (1 + 1.96*1.96/total)"


@query(oracle(f"SELECT model, use_tools, round({_wilson[0]} - {_wilson[1]}, 8) AS low, round({_wilson[0]} + {_wilson[1]}, 8) AS high FROM m", *metric_ctes()))
def st01_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = inference.wilson(F.col("accuracy"), F.col("total"))
    return metrics.compute_metrics(records(spark, sf_dir)).select("model", "use_tools", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


_best = """b AS (SELECT *, first_value(accuracy) OVER w AS best, first_value(total) OVER w AS best_n, first_value(model) OVER w AS best_model FROM m
  WINDOW w AS (PARTITION BY use_tools ORDER BY accuracy DESC, model))"""
_pool = "((round_even(best * best_n, 0) + round_even(accuracy * total, 0)) / (best_n + total))"
_z = f"(best - accuracy) / nullif(sqrt({_pool} * (1 - {_pool}) * (1.0 / best_n + 1.0 / total)), 0)"


@query(oracle(f"SELECT model, use_tools, best_model, round(coalesce({_z}, 0), 8) AS z FROM b WHERE model <> best_model AND total = best_n", *metric_ctes(), _best))
def st05_ztest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.best_against_rest(metrics.compute_metrics(records(spark, sf_dir))).select("model", "use_tools", "best_model", F.round("z", 8).alias("z"))


# the normal distribution function as its series around 0: density times the sum of z ^ (2k + 1) / (1 * 3 * ... * (2k + 1))
_series = "list_sum(list_transform(range(0, 400), lambda k: exp((2 * k + 1) * ln(abs(z)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))))"


@query(
    oracle(
        f"SELECT model, use_tools, round(z, 8) AS z, round(2 * (0.5 - CASE WHEN z = 0 THEN 0 ELSE exp(-z * z / 2) / sqrt(2 * pi()) * {_series} END), 8) AS p FROM q",
        *metric_ctes(), _best, f"q AS (SELECT model, use_tools, coalesce({_z}, 0) AS z FROM b WHERE model <> best_model AND total = best_n)",
    )
)
def st06_normal_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.best_against_rest(metrics.compute_metrics(records(spark, sf_dir))).select("model", "use_tools", F.round("z", 8).alias("z"), F.round("p", 8).alias("p"))


_h = "2 * asin(sqrt(best)) - 2 * asin(sqrt(accuracy))"


@query(
    oracle(
        f"SELECT model, use_tools, round({_h}, 8) AS h, CASE WHEN abs({_h}) < 0.2 THEN 'Small' WHEN abs({_h}) < 0.5 THEN 'Small-Medium' WHEN abs({_h}) < 0.8 THEN 'Medium' ELSE 'Large' END AS effect FROM b",
        *metric_ctes(), _best,
    )
)
def st07_cohens_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.delta_to_best(metrics.compute_metrics(records(spark, sf_dir)), ["use_tools"], "accuracy", "model")
    h, name = inference.cohens_h(F.col("best"), F.col("accuracy"))
    return found.select("model", "use_tools", F.round(h, 8).alias("h"), name.alias("effect"))


_pairs = f"""o AS (SELECT model, use_tools, sample_id, NOT ({FAILED}) AND coalesce(prediction = label, false) AS ok FROM records
  QUALIFY row_number() OVER (PARTITION BY model, use_tools, sample_id ORDER BY event_id DESC) = 1)""", """
p AS (SELECT v.model, count(*) AS n, count(*) FILTER (v.ok AND NOT t.ok) AS n10, count(*) FILTER (NOT v.ok AND t.ok) AS n01,
  count(*) FILTER (v.ok) AS right_plain, count(*) FILTER (t.ok) AS right_tooled
  FROM o v JOIN o t ON v.model = t.model AND v.sample_id = t.sample_id AND NOT v.use_tools AND t.use_tools GROUP BY v.model)"""
_tail = """least(1.0, 2 * list_sum(list_transform(range(0, least(n10, n01) + 1), lambda i: exp(lgamma(n10 + n01 + 1) - lgamma(i + 1) - lgamma(n10 + n01 - i + 1) - (n10 + n01) * ln(2)))))"""


@query(oracle(f"SELECT model, n, n10, n01, right_plain, right_tooled, round(CASE WHEN n10 + n01 = 0 THEN 1.0 ELSE {_tail} END, 8) AS p FROM p ORDER BY p, model", *_pairs))
def jn01_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(comparison.paired(comparison.correctness(records(spark, sf_dir)))).orderBy("p", "model")


_answered = """s AS (SELECT model, use_tools, event_id, confidence AS conf, CAST(prediction = label AS INT) AS ok,
  CASE WHEN prediction = 'fake' THEN confidence ELSE 1 - confidence END AS p_fake, CAST(label = 'fake' AS INT) AS y_fake FROM records
  WHERE """ + ANSWERED + " AND confidence IS NOT NULL)"
_bin = "CASE " + " ".join(f"WHEN conf < {e!r}::DOUBLE THEN {i}" for i, e in enumerate(distribution.ECE_EDGES[1:-1])) + " ELSE 9 END"


@query(oracle("SELECT model, use_tools, round(sum(abs(ok - said)) / sum(n), 8) AS ece, sum(n)::BIGINT AS n FROM b GROUP BY ALL", _answered, f"b AS (SELECT model, use_tools, {_bin} AS bin, count(*) AS n, sum(ok) AS ok, sum(conf) AS said FROM s GROUP BY ALL)"))
def ag14_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution.ece(records(spark, sf_dir)))


_p = "least(greatest(p_fake, 1e-6), 1 - 1e-6)"


@query(oracle(f"SELECT model, use_tools, round(avg(({_p} - y_fake) * ({_p} - y_fake)), 8) AS brier, round(avg(-(y_fake * ln({_p}) + (1 - y_fake) * ln(1 - {_p}))), 8) AS logloss FROM s GROUP BY ALL", _answered))
def ag15_brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution.brier_and_logloss(records(spark, sf_dir)))


_curve = """c AS (SELECT *, row_number() OVER w AS m, count(*) OVER (PARTITION BY model, use_tools) AS n, 1 - sum(ok) OVER w / (row_number() OVER w)::DOUBLE AS risk FROM s
  WINDOW w AS (PARTITION BY model, use_tools ORDER BY conf DESC, event_id ROWS UNBOUNDED PRECEDING))"""


@query(oracle("SELECT model, use_tools, round(sum(risk * CASE WHEN m = n THEN 0.5 ELSE 1 END) / max(n), 8) AS aurc FROM c GROUP BY ALL", _answered, _curve))
def ag16_aurc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution.aurc(records(spark, sf_dir)))


@query(oracle("SELECT model, use_tools, event_id, m, round(risk, 8) AS risk FROM c", _answered, _curve))
def wn03_risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.risk_coverage(records(spark, sf_dir)).select("model", "use_tools", "event_id", "m", F.round("risk", 8).alias("risk"))


_qs = {"p5": 0.05, "p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9, "p95": 0.95}


@query(
    oracle(
        "SELECT model, use_tools, " + ", ".join(f"round(quantile_cont(conf, {q}), 8) AS {k}" for k, q in _qs.items()) + ", round(avg(conf), 8) AS mean, round(median(conf), 8) AS median, count(*) AS n FROM s GROUP BY ALL",
        _answered,
    )
)
def ag18_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distribution.scored(records(spark, sf_dir))
    return rounded(distribution.percentiles(rows, "conf", tuple(_qs.values())))


def _quantiles(name: str, column: str, *ps: float) -> str:
    return ", ".join(f"round(quantile_cont({column}, {p}), 8) AS {name}_p{round(100 * p)}" for p in ps)


@query(
    oracle(
        f"SELECT model, use_tools, {_quantiles('latency_seconds', 'latency_seconds', 0.5, 0.9, 0.95, 0.99)}, {_quantiles('vision', 'vision', 0.5, 0.9, 0.95)}, "
        f"{_quantiles('tool_s', 'tool_s', 0.5, 0.9, 0.95)}, {_quantiles('tool_n', 'tool_n', 0.5, 0.9, 0.95)}, "
        "round((count(*) FILTER (vision < 0.25))::DOUBLE / nullif(count(vision), 0), 8) AS vision_fast, count(vision) AS vision_samples FROM t GROUP BY ALL",
        "t AS (SELECT *, latency_seconds / 4 AS vision, CASE WHEN len(tool_details) > 0 THEN len(tool_details) END AS tool_n, list_sum(list_transform(tool_details, lambda d: d.seconds)) AS tool_s FROM records)",
    )
)
def ag19_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.timing(records(spark, sf_dir))


@query(oracle("SELECT tool, count(*) AS calls FROM (SELECT unnest(tool_usage) AS tool FROM records) GROUP BY tool ORDER BY calls DESC, tool LIMIT 15"))
def tk01_top_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.top_tools(records(spark, sf_dir))


@query(oracle("SELECT model, use_tools, tool, count(*) AS calls FROM (SELECT model, use_tools, unnest(tool_usage) AS tool FROM records) GROUP BY ALL"))
def ag20_tool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.tool_usage(records(spark, sf_dir))


_basic = f"""count(*) AS n_total, count(*) FILTER ({FAILED}) AS n_error, count(*) FILTER ({ABSTAINED}) AS n_abstain,
  count(*) FILTER ({ANSWERED} AND prediction = label) AS n_correct, count(confidence) FILTER ({ANSWERED}) AS n_conf, coalesce(sum(confidence) FILTER ({ANSWERED}), 0) AS sum_conf"""
_tool_rows = f"u AS (SELECT model, use_tools, tool, {_basic} FROM (SELECT *, unnest(tool_usage) AS tool FROM records) GROUP BY ALL)"
_tool_rest = f"r AS (SELECT t.model, t.use_tools, t.tool, {_basic.replace('confidence', 'e.confidence')} FROM u t JOIN records e ON t.model = e.model AND t.use_tools = e.use_tools AND NOT list_contains(e.tool_usage, t.tool) GROUP BY ALL)"


def _acc(t: str) -> str:
    return _div(f"{t}.n_correct", f"{t}.n_total - {t}.n_error - {t}.n_abstain")


@query(
    oracle(
        f"SELECT u.model, u.use_tools, u.tool, u.n_total AS used_n_total, coalesce(r.n_total, 0) AS not_used_n_total, round(u.n_total::DOUBLE / (u.n_total + coalesce(r.n_total, 0)), 8) AS used_rate, "
        f"round({_acc('u')} - coalesce({_acc('r')}, 0), 8) AS delta_accuracy_answered, round({_div('u.sum_conf', 'u.n_conf')} - coalesce({_div('r.sum_conf', 'r.n_conf')}, 0), 8) AS delta_mean_conf_answered "
        "FROM u LEFT JOIN r USING (model, use_tools, tool)",
        _tool_rows, _tool_rest,
    )
)
def ag21_tool_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.tool_conditional(records(spark, sf_dir))
    return rounded(found.select("model", "use_tools", "tool", "used_n_total", "not_used_n_total", "used_rate", "delta_accuracy_answered", "delta_mean_conf_answered"))


@query(
    oracle(
        f"SELECT model, use_tools, tool, n_total, n_error, n_abstain, n_correct, n_conf, round(sum_conf, 6) AS sum_conf FROM (SELECT model, use_tools, tool, {_basic} FROM "
        "(SELECT *, unnest(tool_usage) AS tool FROM records) GROUP BY GROUPING SETS ((model, use_tools, tool), (tool)))"
    )
)
def ag21_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.tool_grouping_sets(records(spark, sf_dir)), 6)


@query(
    oracle(
        f"SELECT model, use_tools, n_total, n_error, n_abstain, n_correct, round({_acc('b')}, 8) AS accuracy_answered, round({_div('sum_conf', 'n_conf')}, 8) AS mean_conf_answered FROM b",
        f"b AS (SELECT model, use_tools, {_basic} FROM records GROUP BY model, use_tools)",
    )
)
def ag11_basic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.basic_rates(records(spark, sf_dir).groupBy("model", "use_tools").agg(*metrics.basic_counts()))
    return rounded(found.select("model", "use_tools", "n_total", "n_error", "n_abstain", "n_correct", "accuracy_answered", "mean_conf_answered"))


@query(
    oracle(
        "SELECT model, use_tools, count(*) AS n, count(DISTINCT sample_id) AS n_ids, substr(sha256(string_agg(sample_id::VARCHAR, chr(10) ORDER BY sample_id::VARCHAR)), 1, 16) AS fingerprint, "
        "array_to_string((list(sample_id::VARCHAR ORDER BY sample_id::VARCHAR))[1:10], ',') AS first_ids FROM records GROUP BY ALL"
    )
)
def ag22_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.fingerprint(records(spark, sf_dir))


@query(
    oracle(
        "SELECT model, use_tools, vision_model, n, rank, present FROM (SELECT *, row_number() OVER (PARTITION BY model, use_tools ORDER BY n DESC, vision_model) AS rank FROM v) JOIN s USING (model, use_tools) WHERE rank <= 5",
        "v AS (SELECT model, use_tools, vision_model, count(*) AS n FROM records WHERE vision_model IS NOT NULL GROUP BY ALL)",
        "s AS (SELECT model, use_tools, round(count(vision_model)::DOUBLE / count(*), 8) AS present FROM records GROUP BY ALL)",
    )
)
def ag23_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.provenance(records(spark, sf_dir))


@query(
    oracle(
        "SELECT model, use_tools, coalesce(arg_max(vision_model, (n, -vision_no)), 'google/gemini-3-flash-preview') AS vision_model, CASE WHEN count(vision_model) > 0 THEN 'models_field' ELSE 'default_gemini' END AS source FROM v GROUP BY model, use_tools",
        "v AS (SELECT model, use_tools, vision_model, count(*) AS n, ascii(substr(vision_model, 2)) AS vision_no FROM records WHERE coalesce(vision_model, '') <> '' GROUP BY ALL)",
    )
)
def fn40_inferred_vision_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.inferred_vision_model(records(spark, sf_dir))


@query(oracle("SELECT model, use_tools, row_number() OVER (PARTITION BY use_tools ORDER BY accuracy DESC, model) AS rank, round(accuracy, 8) AS accuracy FROM m", *metric_ctes()))
def wn01_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.ranked(metrics.compute_metrics(records(spark, sf_dir)), ["use_tools"], [F.desc("accuracy"), F.col("model")])
    return rounded(found.select("model", "use_tools", "rank", "accuracy"))


@query(oracle("SELECT model, use_tools, round(best, 8) AS best, round(best - accuracy, 8) AS delta FROM b", *metric_ctes(), _best))
def wn02_delta_to_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.delta_to_best(metrics.compute_metrics(records(spark, sf_dir)), ["use_tools"], "accuracy", "model").select("model", "use_tools", "best", "delta"))


@query(oracle("SELECT model, use_tools, sample_id, ok FROM o", _pairs[0]))
def wn04_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.correctness(records(spark, sf_dir))


@query(
    oracle(
        f"SELECT model, sample_id, event_id, coalesce(min(CASE WHEN NOT done THEN event_id END) OVER (PARTITION BY model ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), "
        f"min(CASE WHEN NOT done THEN event_id END) OVER (PARTITION BY model)) AS next_open FROM (SELECT *, {ANSWERED} AS done FROM records)"
    )
)
def wn05_next_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).withColumn("done", F.coalesce(metrics.answered(), F.lit(False)))
    return ranking.next_open(rows, ["model"], "event_id", "done").select("model", "sample_id", "event_id", "next_open")


@query(oracle("SELECT sample_id FROM (SELECT sample_id FROM records WHERE use_tools INTERSECT SELECT sample_id FROM records WHERE NOT use_tools)"))
def se01_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return rows.filter("use_tools").select("sample_id").intersect(rows.filter("NOT use_tools").select("sample_id"))


@query(oracle("SELECT DISTINCT model FROM records ORDER BY model"))
def se02_distinct_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("model").distinct().orderBy("model")


@query(oracle("SELECT mode, count(*) AS n, round(sum(latency_seconds), 4) AS seconds FROM (SELECT 'tools' AS mode, * FROM records WHERE use_tools UNION ALL SELECT 'no-tools' AS mode, * FROM records WHERE NOT use_tools) GROUP BY mode"))
def se03_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).select("use_tools", "latency_seconds")
    both = rows.filter("use_tools").unionByName(rows.filter("NOT use_tools"))
    return both.groupBy(metrics.mode_name().alias("mode")).agg(F.count("*").alias("n"), F.round(F.sum("latency_seconds"), 4).alias("seconds"))


@query(oracle("SELECT event_id, model, label, prediction FROM records WHERE contains(lower(model), 'm1') AND use_tools AND prediction IS DISTINCT FROM label"))
def flt03_filter_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.filter_results(records(spark, sf_dir), model="M1", use_tools=True, correct=False).select("event_id", "model", "label", "prediction")


@query(
    oracle(
        "SELECT g.model, g.use_tools, g.trial, coalesce(count(r.event_id), 0) AS n FROM (SELECT DISTINCT a.model, b.use_tools, c.trial FROM records a, (SELECT DISTINCT use_tools FROM records) b, (SELECT DISTINCT trial FROM records) c) g "
        "LEFT JOIN records r ON g.model = r.model AND g.use_tools = r.use_tools AND g.trial = r.trial AND r.prediction = 'fake' GROUP BY ALL"
    )
)
def jn07_dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    grid = metrics.dense_grid(rows, *(rows.select(c).distinct() for c in ("model", "use_tools", "trial")))
    counted = rows.filter("prediction = 'fake'").groupBy("model", "use_tools", "trial").agg(F.count("*").alias("n"))
    return grid.join(counted, ["model", "use_tools", "trial"], "left").na.fill(0, ["n"])


@query(
    oracle(
        "SELECT m.model, m.use_tools, p.model IS NOT NULL AS found, list_filter([CASE WHEN p.model IS NOT NULL AND abs(m.total - p.total) > 1e-9 THEN 'total' END, CASE WHEN p.model IS NOT NULL AND NOT coalesce(abs(m.accuracy - p.accuracy) <= 1e-9, false) THEN 'accuracy' END], lambda x: x IS NOT NULL) AS mismatches "
        "FROM m LEFT JOIN p USING (model, use_tools)",
        *metric_ctes(), "p AS (SELECT model, use_tools, total, CASE WHEN model = 'm1' THEN accuracy + 0.1 ELSE accuracy END AS accuracy FROM m WHERE model <> 'm2')",
    )
)
def jn03_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    computed = metrics.compute_metrics(records(spark, sf_dir))
    changed = F.when(F.col("model") == "m1", F.col("accuracy") + 0.1).otherwise(F.col("accuracy"))
    published = computed.filter("model <> 'm2'").select("model", "use_tools", "total", changed.alias("accuracy"))
    return comparison.validated(computed, published, ["model", "use_tools"], ["total", "accuracy"])


@query(oracle("SELECT tool, seconds, position FROM (SELECT d.tool AS tool, round(d.seconds, 8) AS seconds, position FROM (SELECT unnest(tool_details) AS d, unnest(range(len(tool_details))) AS position FROM records))"))
def jn06_positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    zipped = F.arrays_zip("tool_usage", F.transform("tool_details", lambda d: d["seconds"]).alias("seconds"))
    rows = records(spark, sf_dir).select("tool_usage", zipped.alias("z")).select(F.posexplode("z").alias("position", "z"))
    return rows.select(F.col("z")["tool_usage"].alias("tool"), F.round(F.col("z")["seconds"], 8).alias("seconds"), F.col("position").cast("long").alias("position"))




def _interval(p: str, n: str) -> tuple[str, str]:
    centre, half = f"({p} + 1.96*1.96/(2*{n})) / (1 + 1.96*1.96/{n})", f"1.96 * sqrt({p}*(1-{p})/{n} + 1.96*1.96/(4.0*{n}*{n})) / (1 + 1.96*1.96/{n})"
    return f"CASE WHEN {n} > 0 THEN {centre} - {half} ELSE 0 END", f"CASE WHEN {n} > 0 THEN {centre} + {half} ELSE 0 END"


_ends = {f"{p}_{side}": sql for p, n in (("accuracy", "total"), ("coverage", "total"), ("accuracy_answered", "answered")) for side, sql in zip(("low", "high"), _interval(p, n), strict=True)}
_conf = {"confidence_p5": 0.05, "confidence_p25": 0.25, "confidence_p95": 0.95}


@query(
    oracle(
        f"SELECT model, use_tools, total, answered, round(accuracy, 8) AS accuracy, round({_mcc}, 8) AS mcc, " + ", ".join(f"round({sql}, 8) AS {name}" for name, sql in _ends.items()) + ", "
        + ", ".join(f"round({c}, 8) AS {c}" for c in (*_conf, "brier", "aurc", "latency_seconds_p95")) + ", n_ids, coalesce(v.vision_model, 'google/gemini-3-flash-preview') AS vision_model "
        "FROM m JOIN q USING (model, use_tools) JOIN r USING (model, use_tools) JOIN t USING (model, use_tools) LEFT JOIN v USING (model, use_tools)",
        *metric_ctes(), _answered, _curve,
        "q AS (SELECT model, use_tools, " + ", ".join(f"quantile_cont(conf, {p}) AS {c}" for c, p in _conf.items()) + f", avg(({_p} - y_fake) * ({_p} - y_fake)) AS brier FROM s GROUP BY ALL)",
        "r AS (SELECT model, use_tools, sum(risk * CASE WHEN m = n THEN 0.5 ELSE 1 END) / max(n) AS aurc FROM c GROUP BY ALL)",
        "t AS (SELECT model, use_tools, quantile_cont(latency_seconds, 0.95) AS latency_seconds_p95, count(DISTINCT sample_id) AS n_ids FROM records GROUP BY ALL)",
        "v AS (SELECT model, use_tools, vision_model FROM (SELECT model, use_tools, vision_model, count(*) AS n FROM records WHERE coalesce(vision_model, '') <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY model, use_tools ORDER BY n DESC, vision_model) = 1)",
    )
)
def ag13_config_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.config_summary(records(spark, sf_dir))
    return rounded(found.select("model", "use_tools", "total", "answered", "accuracy", "mcc", *_ends, *_conf, "brier", "aurc", "latency_seconds_p95", "n_ids", "vision_model"))
