"""Statistics over values in groups: windows of an image, coefficients, embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.inference import ratio
from .distribution import exact_percentiles

#: What scales a median deviation to a normal one, and the least deviation.
MAD_SCALE, LEAST_MAD = 1.4826, 1e-12
#: Bounds of the bimodality coefficient and the coefficient of variation.
BIMODAL, POSSIBLY, SPREAD, FEWEST, CONSTANT = 0.6, 0.5, 0.3, 10, 1e-10
# The standard luminance quantisation table of the JPEG standard, by rows.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)


def finite(c: str) -> Column:
    return (~F.isnan(c)) & (F.abs(F.col(c).cast("double")) < float("inf"))


def window_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """min, max, mean, median and population deviation of finite values; zeros without any."""
    x = F.when(finite(value), F.col(value).cast("double"))
    parts = {"min": F.min(x), "max": F.max(x), "mean": F.avg(x), "median": F.median(x), "std": F.stddev_pop(x)}
    return df.groupBy(*by).agg(*(F.coalesce(v, F.lit(0.0)).alias(f"{k}_value") for k, v in parts.items()), F.count(x).alias("n"))


def calibration(windows: DataFrame, image: str, measures: list[str]) -> DataFrame:
    """Reference statistics of each measure over all windows of all images: a row a measure, with the images and windows behind it.

    Medians are exact by ranks, so no measure's values meet in one task.
    """
    long = windows.select(image, F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in measures))).alias("x")).select(image, "x.*")
    long = long.withColumn("v", F.when(finite("v"), F.col("v").cast("double")))
    parts = {"min": F.min("v"), "max": F.max("v"), "mean": F.avg("v"), "std": F.stddev_pop("v")}
    found = long.groupBy("measure").agg(*(F.coalesce(v, F.lit(0.0)).alias(f"{k}_value") for k, v in parts.items()), F.count_distinct(image).alias("num_images"), F.count("*").alias("num_windows"))
    middle = exact_percentiles(long, ["measure"], "v", (0.5,)).select("measure", F.col("value").alias("median_value"))
    return found.join(middle, "measure", "left").withColumn("median_value", F.coalesce("median_value", F.lit(0.0)))


def bimodality(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Bimodality coefficient, coefficient of variation and class of each group's finite values."""
    x = F.when(finite(value), F.col(value).cast("double"))
    m = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("excess"))
    n = F.col("n").cast("double")
    enough, varied = F.col("n") >= FEWEST, F.col("std") >= CONSTANT
    below = F.col("excess") + F.when(n > 3, 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))).otherwise(3.0)
    value_ = F.when(F.abs(below) < 1e-12, 0.0).otherwise((F.col("skew") * F.col("skew") + 1) / below)
    m = m.withColumns({"bc": F.when(enough & varied, value_).otherwise(0.0), "cv": F.when(enough & varied, F.col("std") / (F.abs("mean") + 1e-12))})
    name = (
        F.when(~enough, "insufficient_data").when(~varied, "constant").when(F.col("bc") > BIMODAL, "bimodal").when(F.col("bc") > POSSIBLY, "possibly_bimodal")
        .when(F.col("cv") > SPREAD, "high_variance").otherwise("unimodal")
    )
    return m.withColumn("distribution", name)


def texture(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The population variance of each window's values; 0 for a window without any."""
    return df.groupBy(*by).agg(F.coalesce(F.var_pop(value), F.lit(0.0)).alias("texture"))


def median_mad(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows with their group's median and scaled median deviation."""
    group = Window.partitionBy(*by)
    with_median = df.withColumn("med", F.median(value).over(group))
    mad = F.median(F.abs(F.col(value) - F.col("med"))).over(group) * MAD_SCALE
    return with_median.withColumn("mad", mad).withColumn("mad", F.when(F.col("mad") > 0, F.col("mad")).otherwise(LEAST_MAD))


def robust_z(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return median_mad(df, by, value).withColumn("z", (F.col(value) - F.col("med")) / F.col("mad"))


def log_area_normalized(m: Column, area: Column, reference: float) -> Column:
    """log10 of a window measure made independent of the window's area."""
    clean = F.when(~F.isnan(m) & (F.abs(m) < float("inf")), m).otherwise(0.0)
    return F.log10(clean + 1e-12) - F.log10(F.pow(F.greatest(area, F.lit(1)) / reference, F.lit(3.0)) + 1e-12)


def populations(df: DataFrame, by: list[str], log_m: str, variance: str, flat_below: float, strong_from: float = 5.0) -> DataFrame:
    """Flat windows, textured ones with a strong signal, and the rest."""
    flat = F.col(variance) < flat_below
    strong = ~flat & (F.col(log_m) >= strong_from)
    counted = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(flat).alias("flat"), F.count_if(strong).alias("textured"))
    return counted.withColumns(
        {"intermediate": F.col("n") - F.col("flat") - F.col("textured"), "flat_pct": 100 * ratio(F.col("flat"), F.col("n")), "textured_pct": 100 * ratio(F.col("textured"), F.col("n"))}
    )


def consistency(df: DataFrame, by: list[str], log_m: str, variance: str, flat_below: float, limit: float) -> DataFrame:
    """1 / (1 + deviation) times the share of textured windows that are no low outliers; null below two of them."""
    textured = df.filter(F.col(variance) >= flat_below)
    low = F.avg((F.col("z") < -limit).cast("double"))
    scored = robust_z(textured, by, log_m).groupBy(*by).agg(F.count("*").alias("n_textured"), F.first("mad").alias("mad"), low.alias("low"))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 / (1 + F.col("mad"))) * (1 - F.col("low"))))
    return scored.withColumn("consistency", F.when(F.col("n_textured") >= 2, value))


def weighted_pooling(df: DataFrame, by: list[str], value: str, log_weight: str | None = None) -> DataFrame:
    """Soft minimum, soft maximum, mean and mean square of each group, under weights that sum to one.

    With weights w, the soft maximum is log(sum of w exp(x)), the soft minimum
    -log(sum of w exp(-x)). A sum of exponentials is kept as partial sums by the
    whole part of the exponent, each scaled by it, so nothing overflows and
    partial sums combine map-side; a group's few sums are then scaled to its
    largest. Values that are null or not finite, and weights of zero, count for
    nothing; a group without any other is not in the result.
    """
    x = F.col(value).cast("double")
    lw = F.lit(0.0) if log_weight is None else F.coalesce(F.col(log_weight).cast("double"), F.lit(0.0))
    rows = df.select(*by, x.alias("_x"), lw.alias("_w")).filter(finite("_x") & finite("_w"))

    def term(name: str, exponent: Column) -> Column:
        scaled = F.exp(exponent - F.floor(exponent))
        return F.struct(F.lit(name).alias("name"), F.floor(exponent).alias("whole"), scaled.alias("s"), (scaled * F.col("_x")).alias("s1"), (scaled * F.col("_x") ** 2).alias("s2"))

    terms = rows.select(*by, F.explode(F.array(term("w", F.col("_w")), term("max", F.col("_w") + F.col("_x")), term("min", F.col("_w") - F.col("_x")))).alias("t"))
    part = terms.groupBy(*by, F.col("t.name").alias("name"), F.col("t.whole").alias("whole")).agg(*(F.sum(f"t.{c}").alias(c) for c in ("s", "s1", "s2")))
    down = F.exp((F.col("whole") - F.max("whole").over(Window.partitionBy(*by, "name"))).cast("double"))
    part = part.withColumns({"top": F.max("whole").over(Window.partitionBy(*by, "name")), **{c: F.col(c) * down for c in ("s", "s1", "s2")}})
    sums = part.groupBy(*by, "name").agg(F.any_value("top").alias("top"), *(F.sum(c).alias(c) for c in ("s", "s1", "s2")))

    def of(name: str, c: Column) -> Column:
        return F.max(F.when(F.col("name") == name, c))

    log_sum = F.ln("s") + F.col("top")
    return sums.groupBy(*by).agg(
        (of("w", log_sum) - of("min", log_sum)).alias("soft_min"), (of("max", log_sum) - of("w", log_sum)).alias("soft_max"),
        of("w", F.col("s1") / F.col("s")).alias("mean"), of("w", F.col("s2") / F.col("s")).alias("mean_square"),
    )


def scaled_table(quality: Column) -> Column:
    """The luminance table of a quality from 1 to 100, scaled as the usual encoders do."""
    scale = F.when(quality < 50, 5000.0 / quality).otherwise(200.0 - quality * 2)
    base = F.array(*map(F.lit, LUMA))
    return F.transform(base, lambda b: F.greatest(F.lit(1), F.least(F.lit(255), F.floor((b * scale + 50) / 100).cast("int"))))


def estimated_quality(df: DataFrame, key: list[str], table: str) -> DataFrame:
    """The quality whose table is nearest to each row's, and the mean difference; the first of equals. Keys must tell rows apart.

    A row is compared with the hundred tables where it is, one matrix difference
    for a run of rows: nothing is crossed or shuffled. A table that is null or
    has not 64 entries has no quality.
    """
    qualities = np.arange(1, 101)
    scale = np.where(qualities < 50, 5000.0 / qualities, 200.0 - qualities * 2)
    tables = np.clip(np.floor((np.array(LUMA)[None] * scale[:, None] + 50) / 100), 1, 255)

    @F.pandas_udf("quality int, error double")
    def nearest(rows: pd.Series) -> pd.DataFrame:
        fit = np.array([r is not None and len(r) == 64 for r in rows], bool)
        own = np.array([rows.iloc[i] for i in np.flatnonzero(fit)], np.float64).reshape(-1, 64)
        best, error = np.zeros(len(own), np.int32), np.full(len(own), np.inf)
        for q, candidate in zip(qualities, tables, strict=True):
            now = np.abs(own - candidate).sum(1) / 64
            best[now < error] = q
            np.minimum(error, now, out=error)
        out = pd.DataFrame({"quality": pd.array([None] * len(rows), "Int32"), "error": np.full(len(rows), np.nan)})
        out.loc[fit, "quality"], out.loc[fit, "error"] = best, error
        return out

    found = df.select(*key, nearest(F.col(table).cast("array<double>")).alias("best"))
    error = F.when(F.col("best.quality").isNotNull(), F.col("best.error"))
    return found.select(*key, "best.quality", error.alias("error"), (error == 0).alias("exact"))


def factor_histogram(df: DataFrame, by: list[str], value: str, longest: int = 100) -> DataFrame:
    """For each step q the share of values above 1 that are its multiples; q to the largest value, at most ``longest``.

    Values are counted before they meet the steps: one row for each distinct value.
    """
    size = F.abs(F.round(value)).cast("long")
    counted = df.select(*by, size.alias("c")).filter("c > 1").groupBy(*by, "c").agg(F.count("*").alias("k"))
    divisors = F.filter(F.sequence(F.lit(1), F.least(F.lit(longest).cast("long"), F.col("c")).cast("int")), lambda q: F.col("c") % q == 0)
    hits = counted.withColumn("q", F.explode(divisors)).groupBy(*by, "q").agg(F.sum("k").alias("hits"))
    total = counted.groupBy(*by).agg(F.sum("k").alias("total"), F.max("c").alias("largest"))
    grid = total.withColumn("q", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest).cast("long"), F.col("largest")).cast("int"))))
    return grid.join(hits, [*by, "q"], "left").select(*by, "q", (F.coalesce("hits", F.lit(0)) / F.col("total")).alias("share"))


def factor_step(histogram: DataFrame, by: list[str], threshold: float = 0.7) -> DataFrame:
    """The largest step whose share reaches the threshold."""
    return histogram.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("share") >= threshold, F.col("q"))), F.lit(1)).alias("step"))


def sac_score(histogram: DataFrame, by: list[str]) -> DataFrame:
    """The largest rise of the factor histogram from one step to the next; 0 for a single step."""
    order = Window.partitionBy(*by).orderBy("q")
    rise = F.col("share") - F.lag("share").over(order)
    return histogram.withColumn("rise", rise).groupBy(*by).agg(F.coalesce(F.max("rise"), F.lit(0.0)).alias("sac"))


def contrast_lut(contrast: int) -> Column:
    """256 output levels of a contrast from 0 to 100: the line through (cut, 0) and (255 - cut, 255), clipped and truncated."""
    low = int(contrast / 100 * 128)
    high = 255 - low
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.greatest(F.lit(0.0), F.least(F.lit(255.0), 255.0 * (i - low) / (high - low))).cast("int"))


def scaled_level(value: Column, scale: float) -> Column:
    """A level scaled and clipped to 0 to 255; a negative one is lost."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), value * scale)).cast("int")


def quality_clamp(c: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(100), c))


def fitted_size(width: Column, height: Column, longest: int) -> tuple[Column, Column]:
    """Width and height with the longer side at most so long."""
    share = F.least(F.lit(1.0), longest / F.greatest(width, height))
    return tuple(F.greatest(F.lit(1), F.floor(c * share).cast("int")) for c in (width, height))


def bayer_map(height: Column, width: Column, channel: str, pattern: str = "RGGB") -> Column:
    """Rows of 0 where a Bayer pattern has the channel and 1 elsewhere."""
    places = [(i // 2, i % 2) for i, c in enumerate(pattern.upper()) if c == channel.upper()]

    def cell(y: Column, x: Column) -> Column:
        own = F.lit(False)
        for a, b in places:
            own = own | ((y % 2 == a) & (x % 2 == b))
        return F.when(own, 0).otherwise(1)

    def span(n: Column) -> Column:
        return F.sequence(F.lit(0), n - 1)

    return F.transform(span(height), lambda y: F.transform(span(width), lambda x: cell(y, x)))


def regression(df: DataFrame, by: list[str], values: str) -> DataFrame:
    """Slope and r2 of an array's values over the logarithm of their place from 1; zeros below three values."""
    long = df.select(*by, F.posexplode(values).alias("i", "v")).withColumn("x", F.log(F.col("i") + 1 + 1e-10))
    fit = long.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("v", "x").alias("slope"), F.regr_r2("v", "x").alias("r2"))
    return fit.withColumns({c: F.when(F.col("n") >= 3, F.coalesce(c, F.lit(0.0))).otherwise(0.0) for c in ("slope", "r2")})


def authentic(df: DataFrame, by: list[str], measures: list[str], limits: DataFrame, on: list[str], green_only: bool = False) -> DataFrame:
    """Whether any window has a measure above its limit, in any channel or in green alone."""
    used = ["g"] if green_only else measures
    above = F.lit(False)
    for c in used:
        above = above | (F.col(c) > F.col(f"limit_{c}"))
    return df.join(F.broadcast(limits), on).groupBy(*by).agg(F.bool_or(above).alias("authentic"))  # limits: one row for each pattern


def calibrated(df: DataFrame, measures: list[str], on: list[str]) -> DataFrame:
    """The limit of each measure: its largest value over images known not to be authentic."""
    return df.groupBy(*on).agg(*(F.max(c).alias(f"limit_{c}") for c in measures))
