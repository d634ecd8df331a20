"""The summary of a set of runs: frames, and their Markdown for people."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import inference
from ..operators import comparison, distribution, metrics
from ..sources import writers

#: Tools of a configuration that its summary lists.
TOP_TOOLS = 15


def config_summary(records: DataFrame, by: tuple[str, ...] = metrics.CONFIG) -> DataFrame:
    """All that is said of a configuration, a row each: rates, correlation, intervals, confidence, timing and data set.

    Each part is an aggregation of its own over the records; what is joined are
    rows of configurations.
    """
    keys = list(by)
    config = metrics.compute_metrics(records, by)
    config = config.withColumn("mcc", inference.mcc(*(F.col(c) for c in ("tp", "tn", "fp", "fn"))))
    for name, n in (("accuracy", "total"), ("coverage", "total"), ("accuracy_answered", "answered")):
        low, high = inference.wilson(F.col(name), F.greatest(F.col(n), F.lit(0)))
        config = config.withColumns({f"{name}_low": low, f"{name}_high": high})
    answered = distribution.scored(records)
    quantiles = distribution.percentiles(answered, "conf", distribution.QUANTILES["confidence"], by)
    quantiles = quantiles.select(*keys, *(F.col(c).alias(f"confidence_{c}") for c in quantiles.columns if c not in keys))
    parts = [
        quantiles, distribution.ece(records, by).drop("n"), distribution.brier_and_logloss(records, by), distribution.aurc(records, by), distribution.timing(records, by),
        distribution.fingerprint(records, by).drop("n"), distribution.inferred_vision_model(records, by).withColumnRenamed("source", "vision_source"),
    ]
    for part in parts:
        config = config.join(part, keys, "left")
    return config


def summary_frames(records: DataFrame, by: tuple[str, ...] = metrics.CONFIG) -> dict[str, DataFrame]:
    """Inventory, configurations, comparisons, tools and provenance of records, one row for each thing, in order."""
    keys = list(by)
    config = config_summary(records, by)
    usage = distribution.tool_usage(records, by)
    most = Window.partitionBy(*keys).orderBy(F.desc("calls"), "tool")
    return {
        "inventory": config.select(*keys, "total", "n_ids", "fingerprint", "vision_model", "vision_source").orderBy(*keys),
        "configs": config.orderBy(*keys),
        "paired_tests": comparison.paired(comparison.correctness(records)).orderBy("p", "model"),
        "against_best": comparison.best_against_rest(metrics.compute_metrics(records, by)).select(*keys, "best_model", "accuracy", "best", "z", "p").orderBy(*keys),
        "tools": metrics.tool_conditional(records, by).orderBy(*keys, "tool"),
        "tool_usage": usage.withColumn("rank", F.row_number().over(most)).filter(F.col("rank") <= TOP_TOOLS).orderBy(*keys, "rank"),
        "provenance": distribution.provenance(records, by).orderBy(*keys, "rank"),
    }


def ranked_markdown(records: DataFrame, mode: bool, title: str) -> str:
    """Configurations of one mode by accuracy, as a Markdown section."""
    from ..operators.ranking import ranked

    rows = ranked(metrics.compute_metrics(records).filter(F.col("use_tools") == mode), [], [F.desc("accuracy"), F.col("model")])
    columns = [("rank", "Rank"), ("model", "Model"), ("total", "N"), ("accuracy", "Accuracy"), ("coverage", "Coverage"), ("fake_slip_rate", "Slip"), ("real_false_flag_rate", "False flags")]
    return f"## {title}\n\n" + writers.markdown_table(rows, columns, ["rank"])


def markdown_report(records: DataFrame) -> str:
    """Both rankings and the paired tests. The frames are small: one row for each configuration."""
    paired = summary_frames(records)["paired_tests"]
    tests = writers.markdown_table(paired, [("model", "Model"), ("n", "Pairs"), ("n10", "Only without"), ("n01", "Only with"), ("p", "p")], ["p", "model"])
    return "\n\n".join(["# Summary", ranked_markdown(records, False, "Without tools"), ranked_markdown(records, True, "With tools"), "## Paired tests\n\n" + tests])


def write_summary(records: DataFrame, path: str) -> None:
    """Each frame of the summary as JSON in a folder of its name."""
    for name, frame in summary_frames(records).items():
        frame.write.mode("overwrite").json(f"{path}/{name}")
