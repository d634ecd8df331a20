"""Inferential statistics as column expressions over counts and proportions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import fixed

#: The 97.5 % point of the normal distribution as usually rounded, and the bounds of effect sizes.
Z95 = 1.96
EFFECTS = ((0.2, "Small"), (0.5, "Small-Medium"), (0.8, "Medium"))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom in double, 0 for an empty denominator."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def harmonic(a: Column, b: Column) -> Column:
    """Harmonic mean of two rates: F1 of precision and recall."""
    return ratio(2 * a * b, a + b)


def mcc(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """Matthews correlation; 0 when a margin is empty. The product is taken in double: four counts overflow a long."""
    tp, tn, fp, fn = (c.cast("double") for c in (tp, tn, fp, fn))
    return ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def mcc_explained(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """The correlation in words, with its counts."""
    return F.format_string("MCC = (%d*%d - %d*%d) / sqrt(%d*%d*%d*%d) = %.4f", tp, tn, fp, fn, tp + fp, tp + fn, tn + fp, tn + fn, mcc(tp, tn, fp, fn))


def mcc_trace(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """The correlation step by step; undefined when a margin is empty. The product under the root is exact, to 38 digits."""
    a, b, c, d = tp + fp, tp + fn, tn + fp, tn + fn
    top, exact = tp * tn - fp * fn, a.cast("decimal(19,0)")
    for margin in (b, c, d):
        exact = (exact * margin.cast("decimal(19,0)")).cast("decimal(38,0)")
    under = exact.cast("double")
    steps = F.concat_ws(
        "\n",
        F.format_string("MCC = (%d*%d - %d*%d) / sqrt[(%d+%d)(%d+%d)(%d+%d)(%d+%d)]", tp, tn, fp, fn, tp, fp, tp, fn, tn, fp, tn, fn),
        F.format_string("    = (%d - %d) / sqrt[%d*%d*%d*%d]", tp * tn, fp * fn, a, b, c, d),
        F.concat(F.lit("    = "), top.cast("string"), F.lit(" / sqrt["), exact.cast("string"), F.lit("]")),
        F.concat(F.lit("    = "), top.cast("string"), F.lit(" / "), fixed(F.sqrt(under), 2)),
        F.concat(F.lit("    = "), fixed(top / F.sqrt(under), 4)),
    )
    return F.when(F.least(a, b, c, d) == 0, "undefined (zero in denominator)").otherwise(steps)


def wilson_trace(p: Column, n: Column, z: float = Z95) -> Column:
    """The Wilson interval step by step; null for n <= 0, which has none."""
    m, zz = n.cast("double"), F.lit(z * z)
    spread, small = p * (1 - p) / m, zz / (4 * m * m)
    term, denominator = F.sqrt(spread + small), 1 + zz / m
    margin, half = term * z, zz / (2 * m)
    low, high = (p + half - margin) / denominator, (p + half + margin) / denominator

    def line(said: str, *values: tuple[Column, int]) -> Column:
        parts = said.split("{}")
        out = [F.lit(parts[0])]
        for (value, digits), rest in zip(values, parts[1:], strict=True):
            out += [fixed(value, digits), F.lit(rest)]
        return F.concat(*out)

    steps = F.concat_ws(
        "\n", F.lit(f"Wilson CI (95%, z={z}):"), F.concat(line("  p = {}, n = ", (p, 4)), n.cast("string")), line("  z^2/n = {}", (zz / m, 6)), line("  z^2/2n = {}", (half, 6)),
        line("  p(1-p)/n = {}", (spread, 6)), line("  z^2/4n^2 = {}", (small, 8)), line("  SE term = sqrt({} + {}) = {}", (spread, 6), (small, 8), (term, 6)),
        line(f"  Margin = {z} * {{}} = {{}}", (term, 6), (margin, 6)), line("  Denominator = 1 + {} = {}", (zz / m, 6), (denominator, 6)),
        line("  Lower = ({} + {} - {}) / {} = {}", (p, 4), (half, 6), (margin, 6), (denominator, 6), (low, 4)),
        line("  Upper = ({} + {} + {}) / {} = {}", (p, 4), (half, 6), (margin, 6), (denominator, 6), (high, 4)), line("  95% CI = [{}, {}]", (low, 3), (high, 3)),
    )
    return F.when(n > 0, steps)


def wilson(p: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval of a proportion; (0, 0) for n <= 0. Not clipped to [0, 1]."""
    n = n.cast("double")
    shrink = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / shrink
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / shrink
    empty = n <= 0
    return F.when(empty, 0.0).otherwise(centre - half), F.when(empty, 0.0).otherwise(centre + half)


def mcnemar_exact(n10: Column, n01: Column) -> Column:
    """Two-sided exact p of discordant pairs: twice the binomial tail, at most 1; 1 without any.

    The tail is summed in logarithms, so large counts neither overflow nor vanish.
    """
    b = (n10 + n01).cast("long")
    k = F.least(n10, n01).cast("long")

    def term(state: Column, i: Column) -> Column:
        c = state["c"] + F.log((b - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(c.alias("c"), (state["s"] + F.exp(c - b * math.log(2))).alias("s"))

    start = F.struct(F.lit(0.0).alias("c"), F.exp(-b * math.log(2)).alias("s"))
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(steps, start, term, lambda state: state["s"])
    return F.when(b == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    """Standard normal distribution function, which SQL has no function for."""
    return x.map(lambda v: None if v is None or v != v else 0.5 * math.erfc(-v / math.sqrt(2)))


def two_proportions(p1: Column, n1: Column, p2: Column, n2: Column) -> Column:
    """Pooled z of two proportions, counts rounded half to even; 0 without spread."""
    x1, x2 = F.bround(p1 * n1), F.bround(p2 * n2)
    pool = ratio(x1 + x2, n1 + n2)
    error = F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), n1.cast("double")) + F.try_divide(F.lit(1.0), n2.cast("double"))))
    return F.when(error > 0, (p1 - p2) / error).otherwise(0.0)


def two_sided(z: Column) -> Column:
    """Two-sided p of a z value."""
    return 2 * (1 - normal_cdf(F.abs(z)))


def cohens_h(p1: Column, p2: Column) -> tuple[Column, Column]:
    """Effect size of two proportions, and its name."""
    h = 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))
    name = F.lit("Large")
    for bound, said in reversed(EFFECTS):
        name = F.when(F.abs(h) < bound, said).otherwise(name)
    return h, name
