"""Calibration, risk and distribution measures of evaluation records."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.inference import ratio
from .metrics import CONFIG, abstained, failed
from .ranking import placed

#: Ten equal bins as their edges are in floating point (the 4th, 7th and 8th are not the decimal ones).
ECE_EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)
EPSILON = 1e-6
QUANTILES = {"latency_seconds": (0.5, 0.9, 0.95, 0.99), "confidence": (0.05, 0.1, 0.25, 0.75, 0.9, 0.95)}


def safe_double(c: str | Column) -> Column:
    """A number, or null for what is none; infinite and not-a-number values are kept out as well."""
    value = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def scored(records: DataFrame) -> DataFrame:
    """Answered rows with a usable confidence: conf, ok, p_fake and y_fake."""
    said, gold = F.lower(F.trim("prediction")), F.lower(F.trim(F.coalesce("label", F.lit(""))))
    rows = records.filter(~failed() & ~abstained()).withColumn("conf", clamp(safe_double("confidence"))).filter("conf IS NOT NULL")
    return rows.withColumns(
        {
            "ok": (said == gold).cast("int"),
            "p_fake": F.when(said == "fake", F.col("conf")).otherwise(1 - F.col("conf")),
            "y_fake": (gold == "fake").cast("int"),
        }
    )


def ece_bin(conf: Column, edges: tuple[float, ...] = ECE_EDGES) -> Column:
    """Bin of a confidence: half-open, the last one closed."""
    out = F.lit(len(edges) - 2)
    for i in reversed(range(len(edges) - 2)):
        out = F.when(conf < edges[i + 1], i).otherwise(out)
    return out


def ece(records: DataFrame, by: tuple[str, ...] = CONFIG) -> DataFrame:
    """Expected calibration error of the predicted label, ten bins."""
    binned = scored(records).groupBy(*by, ece_bin(F.col("conf")).alias("bin")).agg(F.count("*").alias("n"), F.sum("ok").alias("right"), F.sum("conf").alias("said"))
    gap = F.abs(F.col("right") - F.col("said"))
    return binned.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def brier_and_logloss(records: DataFrame, by: tuple[str, ...] = CONFIG) -> DataFrame:
    """Brier score and log loss of p(fake), clipped away from 0 and 1."""
    p = clamp(F.col("p_fake"), EPSILON, 1 - EPSILON)
    y = F.col("y_fake")
    return scored(records).groupBy(*by).agg(F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("logloss"))


def risk_coverage(records: DataFrame, by: tuple[str, ...] = CONFIG, key: str = "event_id") -> DataFrame:
    """The risk-coverage curve: m most confident rows of n, and the share of them that is wrong.

    Ties of confidence are ordered by the key, so the curve is defined. A
    configuration is ordered in many ranges.
    """
    rows = scored(records).select(*by, key, "conf", "ok").withColumn("one", F.lit(1))
    rows = placed(rows, list(by), [F.col("conf").desc(), F.col(key)], {"m": "one", "right": "ok"}, "m")
    return rows.withColumnRenamed("all_m", "n").drop("one").withColumn("risk", 1 - F.col("right") / F.col("m"))


def aurc(records: DataFrame, by: tuple[str, ...] = CONFIG, key: str = "event_id") -> DataFrame:
    """Area under the risk-coverage curve by trapezoids: all risks but half the last, by n."""
    weight = F.when(F.col("m") == F.col("n"), 0.5).otherwise(1.0)
    return risk_coverage(records, by, key).groupBy(*by).agg((F.sum(F.col("risk") * weight) / F.max("n")).alias("aurc"))


def exact_percentiles(values: DataFrame, by: list[str], value: str, ps: tuple[float, ...]) -> DataFrame:
    """by, p and the exact percentile of each p with linear interpolation; null values are left out.

    Equal values are counted first, and ranks run over ranges of values, so no
    group's values meet in one task or one buffer.
    """
    counted = values.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"))
    ranks = placed(counted, by, [F.col(value)], {"upto": "k"}, "upto")
    wanted = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), (F.lit(p) * (F.col("all_upto") - 1)).alias("at")) for p in ps))).alias("w")
    hit = ranks.select(*by, value, "upto", "k", wanted).select(*by, value, "upto", "k", "w.p", "w.at")
    low = (F.col("upto") - F.col("k") <= F.floor("at")) & (F.floor("at") < F.col("upto"))
    high = (F.col("upto") - F.col("k") <= F.ceil("at")) & (F.ceil("at") < F.col("upto"))
    ends = hit.filter(low | high).groupBy(*by, "p").agg(F.max(F.when(low, F.col(value))).alias("low"), F.max(F.when(high, F.col(value))).alias("high"), F.any_value(F.col("at") - F.floor("at")).alias("part"))
    return ends.select(*by, "p", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("value"))


def percentiles(df: DataFrame, column: str, ps: tuple[float, ...], by: tuple[str, ...] = CONFIG) -> DataFrame:
    """Exact percentiles with linear interpolation, mean and median; nulls are left out."""
    points = tuple(dict.fromkeys((*ps, 0.5)))
    found = exact_percentiles(df.select(*by, F.col(column).cast("double").alias("_v")), list(by), "_v", points)
    wide = found.groupBy(*by).agg(*(F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{round(100 * p)}" if p in ps else "_median") for p in points))
    rows = df.groupBy(*by).agg(F.avg(column).alias("mean"), F.count(column).alias("n"))
    median = F.col("p50" if 0.5 in ps else "_median").alias("median")
    return _joined(rows, wide, by).select(*by, *(f"p{round(100 * p)}" for p in ps), "mean", median, "n")


def _joined(rows: DataFrame, more: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Two tables of a row a group, null being a group too."""
    named = more.select(*(F.col(c).alias(f"{c}__") for c in by), *(c for c in more.columns if c not in by))
    same = F.lit(True)
    for c in by:
        same &= rows[c].eqNullSafe(named[f"{c}__"])
    return rows.join(named, same, "left").drop(*(f"{c}__" for c in by))


def timing(records: DataFrame, by: tuple[str, ...] = CONFIG, fast: float = 0.25) -> DataFrame:
    """Latency percentiles, tool seconds and counts by row, and the share of fast vision calls."""
    seconds = F.filter(F.transform("tool_details", lambda d: d["seconds"]), lambda s: s.isNotNull())
    used = F.size(seconds) > 0
    rows = records.select(
        *by, F.col("latency_seconds").cast("double").alias("latency_seconds"), (F.col("latency_seconds") / 4).alias("vision"),
        F.when(used, F.aggregate(seconds, F.lit(0.0), lambda a, s: a + s)).alias("tool_s"), F.when(used, F.size(seconds).cast("double")).alias("tool_n"),
    )
    points = {"latency_seconds": (0.5, 0.9, 0.95, 0.99), "vision": (0.5, 0.9, 0.95), "tool_s": (0.5, 0.9, 0.95), "tool_n": (0.5, 0.9, 0.95)}
    long = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("_c"), F.col(c).alias("_v")) for c in points))).alias("x")).select(*by, "x.*")
    found = exact_percentiles(long, [*by, "_c"], "_v", (0.5, 0.9, 0.95, 0.99))
    one = [F.round(F.max(F.when((F.col("_c") == c) & (F.col("p") == p), F.col("value"))), 8).alias(f"{c}_p{round(100 * p)}") for c, ps in points.items() for p in ps]
    vision = rows.groupBy(*by).agg(
        F.round(ratio(F.count_if(F.col("vision") < fast), F.count("vision")), 8).alias("vision_fast"), F.count("vision").alias("vision_samples")
    )
    wide = found.groupBy(*by).agg(*one)
    return _joined(vision, wide, by).select(*by, *(c for c in wide.columns if c not in by), "vision_fast", "vision_samples")


def tool_usage(records: DataFrame, by: tuple[str, ...] = CONFIG) -> DataFrame:
    """Calls and callers of each tool in each group."""
    return records.withColumn("tool", F.explode("tool_usage")).groupBy(*by, "tool").agg(F.count("*").alias("calls"))


def top_tools(records: DataFrame, k: int = 15) -> DataFrame:
    """The k most called tools; ties by name."""
    calls = records.select(F.explode("tool_usage").alias("tool")).groupBy("tool").agg(F.count("*").alias("calls"))
    return calls.orderBy(F.desc("calls"), "tool").limit(k)


def fingerprint(records: DataFrame, by: tuple[str, ...] = CONFIG, key: str = "sample_id") -> DataFrame:
    """What a group's data set is: rows, distinct ids, a hash of the sorted ids, the first ten.

    The hash is of all ids in one text. A group's ids are sorted by the engine,
    which spills, and run through one hash in a task that holds a batch of them
    at a time; nothing else of a row travels.
    """
    kinds = dict(records.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "n long, n_ids long, fingerprint string, first_ids string"])
    form = to_arrow_schema(records.sparkSession.createDataFrame([], schema).schema)
    rows = records.select(*by, F.col(key).cast("string").alias("_id"))
    rows = rows.repartition(*by).sortWithinPartitions(*by, "_id") if by else rows.coalesce(1).sortWithinPartitions("_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def made(s: list) -> pa.RecordBatch:
            group, n, distinct, digest, first, _ = s
            return pa.RecordBatch.from_pylist([{**dict(zip(by, group, strict=True)), "n": n, "n_ids": distinct, "fingerprint": digest.hexdigest()[:16], "first_ids": ",".join(first)}], form)

        for batch in batches:
            for *group, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state[0] != group:
                    if state:
                        yield made(state)
                    state = [group, 0, 0, hashlib.sha256(), [], None]
                state[1] += 1
                if i is None:
                    continue
                state[3].update((i if state[5] is None else "\n" + i).encode())
                if i != state[5]:
                    state[2] += 1
                if len(state[4]) < 10:
                    state[4].append(i)
                state[5] = i
        if state:
            yield made(state)

    return rows.mapInArrow(run, schema)


def provenance(records: DataFrame, by: tuple[str, ...] = CONFIG, k: int = 5) -> DataFrame:
    """The k models that most rows name as their vision model, and the share of rows that name any."""
    counted = records.filter("vision_model IS NOT NULL").groupBy(*by, "vision_model").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "vision_model")
    share = records.groupBy(*by).agg(F.round(ratio(F.count("vision_model"), F.count("*")), 8).alias("present"))
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).join(share, list(by))


# Where no row names a vision model, what a run's file or its agent says of it: rule, column, test, what it looks for, model.
VISION_RULES = (
    ("filename_glm46_vision", "file", "contains", "glm46v-vision_agent_glm46", "z-ai/glm-4.6:nitro"),
    ("filename_g3_prefix", "file", "startswith", "g3", "google/gemini-3-flash-preview"),
    ("filename_g3_prefix", "file", "contains", "g3vision", "google/gemini-3-flash-preview"),
    ("filename_b_or_g3", "file", "equals", "b_or_g3flashprev.jsonl", "google/gemini-3-flash-preview"),
    ("agent_rule_sonnet", "agent", "contains", "claude-sonnet-4.5", "anthropic/claude-sonnet-4.5"),
    ("agent_rule_openai", "agent", "contains", "gpt-5", "gpt-5.2"),
)
VISION_DEFAULT = ("default_gemini", "google/gemini-3-flash-preview")


def inferred_vision_model(
    records: DataFrame, by: tuple[str, ...] = CONFIG, file: str | None = None, agent: str = "model", rules: tuple = VISION_RULES, default: tuple[str, str] = VISION_DEFAULT
) -> DataFrame:
    """Each group's vision model, and which rule said so.

    The model that most rows name (ties by name), else the first rule that fits
    the group's file (any case, if its column is given) or its agent, else the default.
    """
    counted = records.filter("coalesce(vision_model, '') <> ''").groupBy(*by, "vision_model").agg(F.count("*").alias("n"))
    best = counted.groupBy(*by).agg(F.min_by("vision_model", F.struct(-F.col("n"), F.col("vision_model"))).alias("named"))
    seen = {"file": F.lower(F.min(file)) if file else F.lit(None).cast("string"), "agent": F.min(agent)}
    groups = records.groupBy(*by).agg(*(c.alias(f"_{k}") for k, c in seen.items()))
    tests = {"contains": lambda c, v: F.contains(c, F.lit(v)), "startswith": lambda c, v: F.startswith(c, F.lit(v)), "equals": lambda c, v: c == v}
    said = F.struct(F.lit(default[0]).alias("source"), F.lit(default[1]).alias("vision_model"))
    for source, column, test, value, model in reversed(rules):
        said = F.when(tests[test](F.col(f"_{column}"), value), F.struct(F.lit(source).alias("source"), F.lit(model).alias("vision_model"))).otherwise(said)
    found = _joined(groups, best, by).withColumn("said", F.when(F.col("named").isNotNull(), F.struct(F.lit("models_field").alias("source"), F.col("named").alias("vision_model"))).otherwise(said))
    return found.select(*by, "said.vision_model", "said.source")
