"""Confusion and selective-classification metrics of evaluation records.

Everything is one partial and one final aggregation per grouping: conditional
counts and sums first, rates after. The positive class is fake. A record with an
error is an error before it can be an abstention; an empty error text is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.inference import harmonic, ratio

CONFIG = ("model", "use_tools")
#: Rates that trial summaries report.
HEADLINE = (
    "accuracy", "accuracy_answered", "coverage", "balanced_accuracy", "balanced_accuracy_answered", "f1_fake", "f1_real", "precision_fake", "recall_fake",
    "precision_real", "recall_real", "abstain_rate", "abstain_rate_fake", "abstain_rate_real", "coverage_fake", "coverage_real", "fake_slip_rate",
    "real_false_flag_rate", "fake_catch_rate", "real_pass_rate",
)


def failed() -> Column:
    return F.coalesce(F.col("error"), F.lit("")) != ""


def abstained() -> Column:
    return ~failed() & (F.col("prediction").isNull() | (F.col("prediction") == "uncertain"))


def answered() -> Column:
    return ~failed() & F.col("prediction").isin("real", "fake")


def bucket() -> Column:
    """error, abstain or answered."""
    return F.when(failed(), "error").when(abstained(), "abstain").otherwise("answered")


def mode_name(use_tools: Column | None = None) -> Column:
    return F.when(F.col("use_tools") if use_tools is None else use_tools, "tools").otherwise("no-tools")


def counts() -> list[Column]:
    """The aggregates that every rate is made of; sums and counts only, so they combine map-side."""
    label, prediction, ok = F.col("label"), F.col("prediction"), answered()

    def cell(gold: str, said: str) -> Column:
        return F.count_if(ok & (label == gold) & (prediction == said))

    tool_seconds = F.aggregate("tool_details", F.lit(0.0), lambda a, d: a + F.coalesce(d["seconds"], F.lit(0.0)))
    return [
        F.count("*").alias("total"),
        cell("fake", "fake").alias("tp"), cell("real", "real").alias("tn"), cell("real", "fake").alias("fp"), cell("fake", "real").alias("fn"),
        F.count_if(failed()).alias("error_count"), F.count_if(abstained()).alias("abstain_count"),
        F.count_if(abstained() & (label == "fake")).alias("abstain_count_fake"), F.count_if(abstained() & (label == "real")).alias("abstain_count_real"),
        F.count_if(label == "fake").alias("support_fake"), F.count_if(label == "real").alias("support_real"),
        F.coalesce(F.avg(F.when(ok, F.coalesce("confidence", F.lit(0.0)))), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.avg(F.when(ok, F.col("latency_seconds"))), F.lit(0.0)).alias("avg_latency_seconds"),
        F.coalesce(F.avg(F.when(ok, F.coalesce(F.size("tool_usage"), F.lit(0)))), F.lit(0.0)).alias("avg_tool_count"),
        F.coalesce(F.avg(F.when(ok & (tool_seconds > 0), tool_seconds)), F.lit(0.0)).alias("avg_tool_seconds_total"),
    ]


def rates(counted: DataFrame) -> DataFrame:
    """The columns of ``counts`` and every rate made of them; an empty denominator gives 0."""
    c = F.col
    first = counted.withColumns(
        {
            "correct": c("tp") + c("tn"),
            "answered": c("total") - c("error_count") - c("abstain_count"),
            "precision_fake": ratio(c("tp"), c("tp") + c("fp")),
            "recall_fake": ratio(c("tp"), c("tp") + c("fn")),
            "precision_real": ratio(c("tn"), c("tn") + c("fn")),
            "recall_real": ratio(c("tn"), c("tn") + c("fp")),
        }
    )
    second = first.withColumns(
        {
            "accuracy": ratio(c("correct"), c("total")),
            "accuracy_answered": ratio(c("correct"), F.greatest("answered", F.lit(0))),
            "coverage": ratio(c("answered"), c("total")),
            "f1_fake": harmonic(c("precision_fake"), c("recall_fake")),
            "f1_real": harmonic(c("precision_real"), c("recall_real")),
            "balanced_accuracy": (c("recall_fake") + c("recall_real")) / 2,
            "abstain_rate": ratio(c("abstain_count"), c("total")),
            "abstain_rate_fake": ratio(c("abstain_count_fake"), c("support_fake")),
            "abstain_rate_real": ratio(c("abstain_count_real"), c("support_real")),
            "error_rate": ratio(c("error_count"), c("total")),
            # an error counts as covered by class, though not in coverage
            "coverage_fake": ratio(F.greatest(c("support_fake") - c("abstain_count_fake"), F.lit(0)), c("support_fake")),
            "coverage_real": ratio(F.greatest(c("support_real") - c("abstain_count_real"), F.lit(0)), c("support_real")),
            "fake_slip_rate": ratio(c("fn"), c("support_fake")),
            "real_false_flag_rate": ratio(c("fp"), c("support_real")),
            "fake_catch_rate": ratio(c("tp"), c("support_fake")),
            "real_pass_rate": ratio(c("tn"), c("support_real")),
        }
    )
    alike = ("balanced_accuracy", "precision_fake", "recall_fake", "f1_fake", "precision_real", "recall_real", "f1_real")
    return second.withColumns({f"{name}_answered": c(name) for name in alike})


def compute_metrics(records: DataFrame, by: tuple[str, ...] = CONFIG) -> DataFrame:
    """Confusion, support and all rates of each group."""
    return rates(records.groupBy(*by).agg(*counts()))


def token_metrics(records: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Means and totals of token usage; rows without usage are not counted."""
    kinds = ("prompt_tokens", "completion_tokens", "total_tokens")
    sums = [F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(f"sum_{k}") for k in kinds]
    means = [F.round(F.coalesce(F.avg(k), F.lit(0.0)), 8).alias(f"avg_{k}") for k in kinds]
    return records.groupBy(*by).agg(*sums, *means, F.count("total_tokens").alias("with_tokens"))


def running_metrics(records: DataFrame, by: tuple[str, ...] = CONFIG) -> DataFrame:
    """n, acc (of answered), correct, wrong, uncertain and errors; any other answer is wrong."""
    said = ~failed() & ~abstained()
    right = said & F.col("prediction").eqNullSafe(F.col("label"))
    counted = records.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(right).alias("correct"), F.count_if(said & ~right).alias("wrong"),
        F.count_if(abstained()).alias("uncertain"), F.count_if(failed()).alias("errors"),
    )
    return counted.withColumn("acc", ratio(F.col("correct"), F.col("correct") + F.col("wrong")))


def dense_grid(records: DataFrame, *dimensions: DataFrame) -> DataFrame:
    """Every combination of small dimensions, so that an empty cell has its row of zeros.

    The dimensions are distinct values (models, modes, trials): their product is
    the number of result rows, not of records.
    """
    grid = dimensions[0]
    for other in dimensions[1:]:
        grid = grid.crossJoin(other)
    return grid


def metrics_by_trial(records: DataFrame) -> DataFrame:
    """Metrics of each (model, mode, trial) cell of the dense grid; zeros where nothing ran."""
    models, modes, trials = (records.select(c).distinct() for c in ("model", "use_tools", "trial"))
    counted = records.groupBy("model", "use_tools", "trial").agg(*counts())
    dense = dense_grid(records, models, modes, trials).join(counted, ["model", "use_tools", "trial"], "left")
    numbers = [name for name in counted.columns if name not in ("model", "use_tools", "trial")]
    return rates(dense.na.fill(0, numbers))


def trial_summary(by_trial: DataFrame) -> DataFrame:
    """Mean and sample deviation (0 for one trial) of each headline rate over trials, one row a rate."""
    pairs = ", ".join(f"'{name}', {name}" for name in HEADLINE)
    long = by_trial.selectExpr("model", "use_tools", f"stack({len(HEADLINE)}, {pairs}) AS (metric, value)")
    return long.groupBy("model", "use_tools", "metric").agg(
        F.round(F.avg("value"), 8).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 8).alias("std"), F.count("*").alias("trials")
    )


def trial_totals(by_trial: DataFrame) -> DataFrame:
    """Mean row and support totals over trials, with mean error and abstention rates."""
    return by_trial.groupBy("model", "use_tools").agg(
        *(F.round(F.avg(c), 8).alias(f"avg_{c}") for c in ("total", "support_fake", "support_real")),
        *(F.round(F.avg(c), 8).alias(f"mean_{c}") for c in ("error_rate", "abstain_rate")),
    )


BASIC = ("n_total", "n_error", "n_abstain", "n_correct", "n_conf", "sum_conf")


def basic_counts() -> list[Column]:
    """Additive parts of the basic metrics; labels and predictions are trimmed and lower-cased."""
    gold = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    said = F.lower(F.trim("prediction"))
    conf = F.when(answered(), F.least(F.greatest(F.expr("try_cast(confidence AS double)"), F.lit(0.0)), F.lit(1.0)))
    return [
        F.count("*").alias("n_total"), F.count_if(failed()).alias("n_error"), F.count_if(abstained()).alias("n_abstain"),
        F.count_if(answered() & (gold == said)).alias("n_correct"), F.count(conf).alias("n_conf"), F.coalesce(F.sum(conf), F.lit(0.0)).alias("sum_conf"),
    ]


def basic_rates(df: DataFrame, prefix: str = "") -> DataFrame:
    """Rates of additive parts with a prefix: answered, accuracies, coverage and mean confidence."""

    def c(name: str) -> Column:
        return F.col(prefix + name)

    left = c("n_total") - c("n_error") - c("n_abstain")
    return df.withColumns(
        {
            f"{prefix}n_answered": left,
            f"{prefix}accuracy_overall": ratio(c("n_correct"), c("n_total")),
            f"{prefix}accuracy_answered": ratio(c("n_correct"), left),
            f"{prefix}coverage": ratio(left, c("n_total")),
            f"{prefix}abstain_rate": ratio(c("n_abstain"), c("n_total")),
            f"{prefix}error_rate": ratio(c("n_error"), c("n_total")),
            f"{prefix}mean_conf_answered": ratio(c("sum_conf"), c("n_conf")),
        }
    )


def tool_conditional(records: DataFrame, by: tuple[str, ...] = CONFIG) -> DataFrame:
    """Basic metrics of rows that used a tool and of those that did not, and what differs.

    Rows that did not use a tool are the group's totals less those that did:
    every part is additive, so no row is crossed with the tools.
    """
    used = records.withColumn("tool", F.explode(F.array_distinct("tool_usage"))).groupBy(*by, "tool").agg(*basic_counts())
    total = records.groupBy(*by).agg(*basic_counts())
    renamed = total.select(*by, *(F.col(n).alias(f"all_{n}") for n in BASIC))
    joined = used.select(*by, "tool", *(F.col(n).alias(f"used_{n}") for n in BASIC)).join(renamed, list(by))
    joined = joined.withColumns({f"not_used_{n}": F.col(f"all_{n}") - F.col(f"used_{n}") for n in BASIC})
    out = basic_rates(basic_rates(joined, "used_"), "not_used_")
    return out.withColumns(
        {
            "used_rate": ratio(F.col("used_n_total"), F.col("all_n_total")),
            "delta_accuracy_answered": F.col("used_accuracy_answered") - F.col("not_used_accuracy_answered"),
            "delta_mean_conf_answered": F.col("used_mean_conf_answered") - F.col("not_used_mean_conf_answered"),
        }
    )


def tool_grouping_sets(records: DataFrame) -> DataFrame:
    """Basic parts of each tool by configuration and over all, in one pass with grouping sets."""
    long = records.withColumn("tool", F.explode(F.array_distinct("tool_usage")))
    sets = long.groupingSets([[F.col("model"), F.col("use_tools"), F.col("tool")], [F.col("tool")]], "model", "use_tools", "tool")
    return sets.agg(*basic_counts())
