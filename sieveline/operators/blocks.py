"""Block statistics as relations: blocks are rows, whatever image they are of, and histograms count over all images at once.

An image is one of ``by`` columns; nothing after the cut holds a whole image. The
transform runs over batches of blocks. Histograms have a row for each frequency
and value of an image, a few thousand a frequency at most, since coefficients
of bytes are bounded; what is made of one histogram, its teeth and the odds of
its values, is joined back to the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import image_kernels as kernels
from ..functions.image_bytes import ZIGZAG

#: Decimals that a coefficient keeps before it is rounded to a whole number, so that halves are halves.
CLEAN = 6
#: Frequencies, in zigzag order, whose histograms say whether a block was changed.
FIRST = 15
BASIS = np.einsum("ui,vj->uvij", kernels.DCT, kernels.DCT).reshape(64, 64)


def image_blocks(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block_row, block_column and values (64 grey levels, by rows) of every whole block of every image that can be read."""
    kinds = dict(pixels.dtypes)
    names = [*keys, "block_row", "block_column", "values"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (h, w, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("height", "width", "rgb")), strict=True)):
                if raw is None or not h or not w or len(raw) != 3 * h * w:
                    continue
                b = kernels.blockify(kernels.grey(np.frombuffer(raw, np.uint8).reshape(h, w, 3)))
                for r, line in enumerate(b):
                    n = len(line)
                    if n:
                        values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 64, pa.int32()), pa.array(line.reshape(-1).astype(np.int32)))
                        own = [batch.column(k).take(pa.array(np.full(n, i))) for k in keys]
                        yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(n, r), pa.int32()), pa.array(np.arange(n), pa.int32()), values], names)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "block_row int, block_column int, values array<int>"])
    return pixels.select(*keys, "height", "width", "rgb").mapInArrow(run, schema)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def coefficients(values: pd.Series) -> pd.Series:
    """The transform of blocks of 64 levels, by rows, as whole numbers; null for a block of another size."""
    out: list[np.ndarray | None] = [None] * len(values)
    good = [i for i, v in enumerate(values) if v is not None and len(v) == 64]
    if good:
        flat = (np.stack([values.iloc[i] for i in good]).astype(np.float64) - 128) @ BASIS.T
        for i, row in zip(good, np.rint(np.round(flat, CLEAN)).astype(np.int32), strict=True):
            out[i] = row
    return pd.Series(out, dtype=object)


def transformed(blocks: DataFrame) -> DataFrame:
    """Blocks with their coefficients c, and whether they are whole: whether they touch neither 0 nor 255."""
    whole = (F.array_min("values") > 0) & (F.array_max("values") < 255)
    return blocks.withColumns({"c": coefficients("values"), "whole": whole}).filter("c IS NOT NULL")


def counted(rows: DataFrame, by: list[str]) -> DataFrame:
    """n and n_whole (in whole blocks) for each frequency k (by rows, from 0) and value v of each image."""
    long = rows.select(*by, "whole", F.posexplode("c").alias("k", "v"))
    return long.groupBy(*by, "k", "v").agg(F.count("*").alias("n"), F.count_if("whole").alias("n_whole"))


def shares(counts: DataFrame, by: list[str], n: str, longest: int = 100) -> DataFrame:
    """For q from 1 the share of magnitudes above 1 that are multiples of q, counted from values and how often they come."""
    size = counts.groupBy(*by, F.abs("v").alias("size")).agg(F.sum(n).alias("n")).filter("size > 1 AND n > 0")
    divisors = F.filter(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("size"))), lambda q: F.col("size") % q == 0)
    hits = size.select(*by, "n", F.explode(divisors).alias("q")).groupBy(*by, "q").agg(F.sum("n").alias("hits"))
    total = size.groupBy(*by).agg(F.sum("n").alias("total"), F.max("size").alias("largest"))
    grid = total.withColumn("q", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("largest")))))
    return with_row(grid, hits, [*by, "q"]).select(*by, "q", (F.coalesce("hits", F.lit(0)) / F.col("total")).alias("share"))


def with_row(rows: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of their keys' row, or nulls without one; nulls are keys too."""
    named = one.select(*(F.col(k).alias(f"{k}__") for k in keys), *(c for c in one.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same &= rows[k].eqNullSafe(named[f"{k}__"])
    return rows.join(named, same, "left").drop(*(f"{k}__" for k in keys))


def primary_steps(counts: DataFrame, by: list[str], threshold: float = 0.7) -> DataFrame:
    """The step of each frequency k: the largest of which enough values of whole blocks are multiples; 0 without values above 1."""
    found = shares(counts, [*by, "k"], "n_whole").groupBy(*by, "k").agg(F.max(F.when(F.col("share") >= threshold, F.col("q"))).alias("step"))
    return with_row(counts.select(*by, "k").distinct(), found, [*by, "k"]).select(*by, "k", F.coalesce("step", F.lit(0)).alias("step"))


def sac(counts: DataFrame, by: list[str]) -> DataFrame:
    """The largest rise in the shares of multiples of an image, without the constant frequency; 0 where there is none."""
    found = shares(counts.filter("k > 0"), by, "n")
    rise = F.col("share") - F.lag("share").over(Window.partitionBy(*by).orderBy("q"))
    risen = found.withColumn("rise", rise).groupBy(*by).agg(F.max("rise").alias("rise"))
    return with_row(counts.select(*by).distinct(), risen, by).select(*by, F.coalesce("rise", F.lit(0.0)).alias("sac"))


TEETH = T.StructType().add("period", T.IntegerType()).add("values", T.ArrayType(T.IntegerType())).add("odds", T.ArrayType(T.DoubleType()))


@F.pandas_udf(TEETH)
def teeth(values: pd.Series, n: pd.Series) -> pd.DataFrame:
    """The spacing of a histogram's teeth, and the log odds of its values if there are teeth; a value past either end counts 0."""
    out = []
    for v, k in zip(values, n, strict=True):
        v, k = np.asarray(v, np.int64), np.asarray(k, np.int64)
        counts = np.zeros(v.max() - v.min() + 3, np.int64)
        counts[v - v.min() + 1] = k
        p = kernels.period(counts)
        odds = kernels.value_odds(counts, p)[v - v.min() + 1] if p > 1 else np.zeros(len(v))
        out.append((p, v.astype(np.int32), odds))
    return pd.DataFrame(out, columns=["period", "values", "odds"])


def periods(counts: DataFrame, by: list[str], first: int = FIRST) -> DataFrame:
    """period, and odds by value, of the histograms of the first frequencies in zigzag order (k by rows)."""
    rows = counts.filter(F.col("k").isin(ZIGZAG[:first])).groupBy(*by, "k").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("h"))
    return rows.withColumn("t", teeth("h.v", "h.n")).select(*by, "k", "t.*")


def changed_blocks(rows: DataFrame, found: DataFrame, by: list[str], block: list[str]) -> DataFrame:
    """How likely each block is changed: the log odds of its values, from ``periods``, are added up, frequencies taken as independent."""
    table = found.filter("period > 1").select(*by, "k", F.explode(F.arrays_zip("values", "odds")).alias("x")).select(*by, "k", F.col("x.values").alias("v"), "x.odds")
    long = rows.select(*by, *block, F.posexplode("c").alias("k", "v")).filter(F.col("k").isin(ZIGZAG[:FIRST]))
    odds = with_row(long, table, [*by, "k", "v"]).groupBy(*by, *block).agg(F.sum(F.coalesce("odds", F.lit(0.0))).alias("odds"))
    return odds.withColumn("changed", 1 / (1 + F.exp(-F.col("odds"))))
