"""Queries of image operators; those without an oracle are checked by tests against brute force."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.image_bytes import ZIGZAG
from ..operators import blocks, images, tiles
from ..session import spread, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SIDE = 48


def query(f):  # noqa: ANN001, ANN201
    QUERIES[f.__name__] = f
    return f


def _drawn(values, grey: bool = False) -> bytes:  # noqa: ANN001
    import numpy as np

    x = np.asarray(values, np.float64)[:64].reshape(8, 8)
    big = np.kron(x, np.ones((SIDE // 8, SIDE // 8))) * 200 + 128
    wave = np.add.outer(np.arange(SIDE), np.arange(SIDE)) % 7
    return np.clip(np.stack([big + wave] * 3 if grey else [big + wave, big - wave, big.T + wave], 2), 0, 255).astype(np.uint8).tobytes()


def pictures(spark: SparkSession, sf_dir: str, grey: bool = False) -> DataFrame:
    """An RGB image for each embedding: its values as an 8 x 8 pattern, enlarged, with a filter pattern on top; in grey if asked."""

    @F.pandas_udf(T.BinaryType())
    def drawn(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _drawn(v, grey))

    return sketches(spark, sf_dir).withColumn("rgb", drawn("rgb"))


def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pictures`` before they are drawn: rgb is the embedding, of which ``_drawn`` makes pixels inside a task.

    Dealt over the cores, as an image is long work and a file of embeddings small.
    """
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("rgb")).repartition(spread(spark), "vec_id")
    return rows.select("vec_id", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), "rgb")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


GREY = f"""px AS (SELECT vec_id, i, j, floor(least(greatest(embedding[1 + (i // {SIDE // 8}) * 8 + j // {SIDE // 8}]::DOUBLE * 200 + 128 + (i + j) % 7, 0), 255)) AS g FROM embeddings, range({SIDE}) a(i), range({SIDE}) b(j))"""
BLUR = f"""k AS (SELECT k, exp(-0.5 * k * k) / sum(exp(-0.5 * k * k)) OVER () AS weight FROM range(-3, 4) t(k)),
down AS (SELECT p.vec_id, p.i, p.j, any_value(p.g) AS g, sum(weight * q.g) AS s FROM px p CROSS JOIN k JOIN px q ON q.vec_id = p.vec_id AND q.j = p.j AND q.i = least(greatest(p.i + k, 0), {SIDE - 1}) GROUP BY ALL),
res AS (SELECT p.vec_id, p.i, p.j, any_value(p.g) - sum(weight * q.s) AS r FROM down p CROSS JOIN k JOIN down q ON q.vec_id = p.vec_id AND q.i = p.i AND q.j = least(greatest(p.j + k, 0), {SIDE - 1}) GROUP BY ALL)"""
ORACLES["kr25_tiled_residuals"] = f"""WITH {GREY}, {BLUR}, m AS (SELECT vec_id, count(*) AS n, avg(r) AS mean, stddev_pop(r) AS std, avg(r * r) AS energy, avg(abs(r)) AS abs_mean, stddev_pop(abs(r)) AS abs_std, quantile_cont(abs(r), 0.95) AS abs_p95 FROM res GROUP BY vec_id),
z AS (SELECT vec_id, avg(pow((r - mean) / std, 3)) AS skew, avg(pow((r - mean) / std, 4)) - 3 AS kurtosis FROM res JOIN m USING (vec_id) GROUP BY vec_id)
SELECT vec_id, 'completed' AS status, n, {', '.join(f'round({c}, 6) AS {c}' for c in ('mean', 'std', 'skew', 'kurtosis', 'energy', 'abs_mean', 'abs_std', 'abs_p95'))} FROM m JOIN z USING (vec_id)"""


@query
def kr25_tiled_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 24 pixels with a halo of 6, of which 3 are shared with the neighbours: 16 tiles an image."""
    return _rounded(tiles.tiled_residuals(pictures(spark, sf_dir, grey=True), ["vec_id"], side=24, halo=6, shared=3).drop("error"))


@query
def kr23_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(images.frequency(sketches(spark, sf_dir), ["vec_id"], read=_drawn))


@query
def kr11_block_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.block_analysis(sketches(spark, sf_dir), ["vec_id"], read=_drawn).withColumn("sac", F.round("sac", 6)).drop("tamper")


@query
def kr18_error_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(images.error_level(sketches(spark, sf_dir), ["vec_id"], read=_drawn))


@query
def kr24_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(images.residuals(sketches(spark, sf_dir), ["vec_id"], read=_drawn))


@query
def kr37_pattern_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = images.pattern_windows(sketches(spark, sf_dir), ["vec_id"], window=32, read=_drawn)
    return found.select("vec_id", "y", "x", "status", *(F.round(c, 2).alias(c) for c in ("m_r", "m_g", "m_b")), F.round("texture", 6).alias("texture"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a block of an image, which is its label: levels from its first 64 values."""
    levels = F.transform(F.slice("embedding", 1, 64), lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v.cast("double") * 40 + 128))).cast("int"))
    return blocks.transformed(table(spark, sf_dir, "embeddings").select("vec_id", "label", levels.alias("values")))


LEVELS = "lv AS (SELECT vec_id, label, i // 8 AS y, i % 8 AS x, floor(greatest(0.0, least(255.0, embedding[i + 1]::DOUBLE * 40 + 128))) AS g FROM embeddings, range(64) r(i) WHERE len(embedding) >= 64)"
COEFFICIENTS = f"""{LEVELS}, d AS (SELECT u, i, sqrt((CASE WHEN u = 0 THEN 1 ELSE 2 END) / 8.0) * cos((2 * i + 1) * u * pi() / 16) AS w FROM range(8) a(u), range(8) b(i)),
half AS (SELECT vec_id, label, u, x, sum(w * (g - 128)) AS s FROM lv JOIN d ON i = y GROUP BY ALL),
co AS (SELECT vec_id, label, (h.u * 8 + d.u)::INT AS k, round_even(round(sum(w * s), 6), 0)::INT AS v FROM half h JOIN d ON i = x GROUP BY ALL),
wh AS (SELECT vec_id, bool_and(g > 0 AND g < 255) AS whole FROM lv GROUP BY vec_id)"""
DIVISORS = "dv AS (SELECT *, unnest(list_filter(range(1, least(100, size) + 1), lambda q: size % q = 0)) AS q FROM sz)"
ORACLES["kr11_primary_steps"] = f"""WITH {COEFFICIENTS}, sz AS (SELECT label, k, abs(v) AS size, count(*) AS n FROM co JOIN wh USING (vec_id) WHERE whole AND abs(v) > 1 GROUP BY ALL), {DIVISORS},
h AS (SELECT label, k, q, sum(n) AS hits FROM dv GROUP BY ALL), t AS (SELECT label, k, sum(n) AS total FROM sz GROUP BY ALL)
SELECT label, k, coalesce(max(CASE WHEN hits / total >= 0.7 THEN q END), 0)::INT AS step FROM (SELECT DISTINCT label, k FROM co) LEFT JOIN h USING (label, k) LEFT JOIN t USING (label, k) GROUP BY label, k"""
ORACLES["kr14_block_sac"] = f"""WITH {COEFFICIENTS}, sz AS (SELECT label, abs(v) AS size, count(*) AS n FROM co WHERE k > 0 AND abs(v) > 1 GROUP BY ALL), {DIVISORS},
h AS (SELECT label, q, sum(n) AS hits FROM dv GROUP BY ALL), t AS (SELECT label, sum(n) AS total, least(100, max(size)) AS top FROM sz GROUP BY ALL),
g AS (SELECT label, total, unnest(range(1, top + 1)) AS q FROM t), s AS (SELECT g.label, g.q, coalesce(hits, 0) / total AS share FROM g LEFT JOIN h USING (label, q)),
r AS (SELECT label, share - lag(share) OVER (PARTITION BY label ORDER BY q) AS rise FROM s)
SELECT label, round(coalesce(max(rise), 0.0), 8) AS sac FROM (SELECT DISTINCT label FROM co) LEFT JOIN r USING (label) GROUP BY label"""
TEETH = f"""{COEFFICIENTS}, c AS (SELECT label, k, v, count(*) AS n FROM co WHERE k IN ({', '.join(map(str, ZIGZAG[:15]))}) GROUP BY ALL),
m AS (SELECT label, k, min(v) - 1 AS low, max(v) - min(v) + 3 AS size, arg_max(v, n * 100000 - v) AS top FROM c GROUP BY ALL),
sp AS (SELECT label, k, size, f, sqrt(pow(sum(n * cos(2 * pi() * f * (v - low) / size)), 2) + pow(sum(n * sin(2 * pi() * f * (v - low) / size)), 2)) AS s FROM c JOIN m USING (label, k), LATERAL (SELECT unnest(range(0, size // 2 + 1)) AS f) GROUP BY label, k, size, f),
ri AS (SELECT *, lead(s) OVER w > s AS rises FROM sp WINDOW w AS (PARTITION BY label, k ORDER BY f)),
fi AS (SELECT label, k, coalesce(min(f) FILTER (rises), max(f)) AS first, any_value(s) FILTER (f = 0) AS s0 FROM ri GROUP BY ALL),
te AS (SELECT label, k, any_value(size) AS size, any_value(s0) AS s0, arg_max(f, s) AS strongest, max(s) AS most, min(s) AS least FROM sp JOIN fi USING (label, k) WHERE f >= first AND f < greatest(first + 1, size // 2) GROUP BY ALL),
pe AS (SELECT label, k, CASE WHEN strongest > 0 AND 5 * most >= s0 AND least <= 0.9 * greatest(most, 1e-9) THEN greatest(1, round_even(size / strongest, 0)) ELSE 1 END::INT AS period FROM te)"""
ORACLES["kr16_periods"] = f"WITH {TEETH} SELECT label, k, period FROM pe"
ORACLES["kr17_changed_blocks"] = f"""WITH {TEETH}, va AS (SELECT c.*, low, size, period, (((v - top) % period) + period) % period AS past FROM c JOIN m USING (label, k) JOIN pe USING (label, k) WHERE period > 1),
tt AS (SELECT *, ((((v - low) - past) % size) + size) % size AS tooth FROM va),
su AS (SELECT tt.label, tt.k, tt.v, any_value(tt.n) AS n, any_value(period) AS period, sum(c.n) AS around FROM tt, LATERAL (SELECT unnest(range(0, period)) AS j) JOIN c ON c.label = tt.label AND c.k = tt.k AND c.v = (tooth + j) % size + low GROUP BY tt.label, tt.k, tt.v),
od AS (SELECT label, k, v, least(ln(1e9 - 1), greatest(-ln(1e9 - 1), -ln(period * n / around))) AS odds FROM su)
SELECT vec_id, label, any_value(whole) AS whole, round(1 / (1 + exp(-sum(coalesce(odds, 0)))), 6) AS changed FROM co JOIN wh USING (vec_id) LEFT JOIN od USING (label, k, v) GROUP BY vec_id, label"""


@query
def kr11_primary_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.primary_steps(blocks.counted(_blocks(spark, sf_dir), ["label"]), ["label"])


@query
def kr14_block_sac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.sac(blocks.counted(_blocks(spark, sf_dir), ["label"]), ["label"]).withColumn("sac", F.round("sac", 8))


@query
def kr16_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.periods(blocks.counted(_blocks(spark, sf_dir), ["label"]), ["label"]).select("label", "k", "period")


@query
def kr17_changed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir)
    found = blocks.changed_blocks(rows, blocks.periods(blocks.counted(rows, ["label"]), ["label"]), ["label"], ["vec_id", "whole"])
    return found.select("vec_id", "label", "whole", F.round("changed", 6).alias("changed"))
