"""Queries of array statistics and kernels that SQL can check, over embeddings, parts and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arrays, ranking
from ..session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, i and v of every embedding value."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


LONG = "l AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"


@query(f"WITH {LONG} SELECT vec_id, round(min(v), 8) AS min_value, round(max(v), 8) AS max_value, round(avg(v), 8) AS mean_value, round(median(v), 8) AS median_value, round(stddev_pop(v), 8) AS std_value, count(v) AS n FROM l GROUP BY vec_id")
def ag30_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(arrays.window_stats(long_form(spark, sf_dir), ["vec_id"], "v"))


_moments = f"""WITH {LONG}, m AS (SELECT vec_id, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, kurtosis_pop(v) AS excess FROM l GROUP BY vec_id),
s AS (SELECT vec_id, any_value(n) AS n, any_value(mean) AS mean, any_value(std) AS std, any_value(excess) AS excess, avg(pow((v - mean) / std, 3)) AS skew FROM l JOIN m USING (vec_id) GROUP BY vec_id),
b AS (SELECT *, (skew * skew + 1) / (excess + 3.0 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))) AS bc, std / (abs(mean) + 1e-12) AS cv FROM s)"""


@query(f"{_moments} SELECT vec_id, n, round(bc, 6) AS bc, round(skew, 6) AS skew, round(excess, 6) AS excess, CASE WHEN bc > 0.6 THEN 'bimodal' WHEN bc > 0.5 THEN 'possibly_bimodal' WHEN cv > 0.3 THEN 'high_variance' ELSE 'unimodal' END AS distribution FROM b")
def ag31_bimodality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(arrays.bimodality(long_form(spark, sf_dir), ["vec_id"], "v").select("vec_id", "n", "bc", "skew", "excess", "distribution"), 6)


_mad = "g AS (SELECT *, median(v) OVER (PARTITION BY vec_id) AS med FROM l), d AS (SELECT *, 1.4826 * median(abs(v - med)) OVER (PARTITION BY vec_id) AS mad FROM g)"


@query(f"WITH {LONG}, {_mad} SELECT DISTINCT vec_id, round(med, 8) AS med, round(mad, 8) AS mad FROM d")
def ag32_median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(arrays.median_mad(long_form(spark, sf_dir), ["vec_id"], "v").select("vec_id", "med", "mad").distinct())


@query(f"WITH {LONG}, {_mad} SELECT vec_id, i, round((v - med) / CASE WHEN mad > 0 THEN mad ELSE 1e-12 END, 6) AS z FROM d")
def wn07_robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(arrays.robust_z(long_form(spark, sf_dir), ["vec_id"], "v").select("vec_id", "i", "z"), 6)


WINDOWS = "SELECT vec_id, i, abs(v) * 1e7 AS m, (i + 1) * 1024 AS area, v * v AS tvar FROM l"


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long_form(spark, sf_dir).selectExpr("vec_id", "i", "abs(v) * 1e7D AS m", "(i + 1) * 1024 AS area", "v * v AS tvar")
    return rows.withColumn("log_m", arrays.log_area_normalized(F.col("m"), F.col("area"), 65536.0))


_log = f"w AS ({WINDOWS}), x AS (SELECT *, log10(m + 1e-12) - log10(pow(area / 65536.0, 3) + 1e-12) AS log_m FROM w)"


@query(f"WITH {LONG}, {_log} SELECT vec_id, i, round(log_m, 6) AS log_m FROM x")
def kr39_log_area_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows(spark, sf_dir).select("vec_id", "i", "log_m"), 6)


@query(f"WITH {LONG}, {_log}, p AS (SELECT vec_id, count(*) AS n, count(*) FILTER (tvar < 0.002) AS flat, count(*) FILTER (NOT tvar < 0.002 AND log_m >= 6) AS textured FROM x GROUP BY vec_id) SELECT *, n - flat - textured AS intermediate, round(100.0 * flat / n, 8) AS flat_pct, round(100.0 * textured / n, 8) AS textured_pct FROM p")
def ag33_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(arrays.populations(windows(spark, sf_dir), ["vec_id"], "log_m", "tvar", 0.002, 6.0))


@query(f"""WITH {LONG}, {_log}, t AS (SELECT * FROM x WHERE tvar >= 0.002), g AS (SELECT *, median(log_m) OVER (PARTITION BY vec_id) AS med FROM t),
d AS (SELECT *, 1.4826 * median(abs(log_m - med)) OVER (PARTITION BY vec_id) AS mad0 FROM g), z AS (SELECT *, CASE WHEN mad0 > 0 THEN mad0 ELSE 1e-12 END AS mad FROM d),
c AS (SELECT vec_id, count(*) AS n_textured, any_value(mad) AS mad, avg(CASE WHEN (log_m - med) / mad < -2.5 THEN 1.0 ELSE 0.0 END) AS low FROM z GROUP BY vec_id)
SELECT vec_id, n_textured, round(CASE WHEN n_textured >= 2 THEN greatest(0.0, least(1.0, (1 / (1 + mad)) * (1 - low))) END, 6) AS consistency FROM c""")
def kr33_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(arrays.consistency(windows(spark, sf_dir), ["vec_id"], "log_m", "tvar", 0.002, 2.5).select("vec_id", "n_textured", "consistency"), 6)


@query(f"WITH {LONG}, w AS ({WINDOWS}) SELECT label, bool_or(m > 2e6 + 1000 * label) AS authentic FROM w JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) GROUP BY label")
def ag36_authentic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id").withColumnRenamed("m", "g")
    limits = table(spark, sf_dir, "embeddings").select("label").distinct().withColumn("limit_g", 2e6 + 1000 * F.col("label"))
    return arrays.authentic(rows, ["label"], ["g"], limits, ["label"], green_only=True)


@query(f"WITH {LONG}, w AS ({WINDOWS}) SELECT label, round(max(m), 4) AS limit_m FROM w JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) GROUP BY label")
def ag35_calibrated_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return rounded(arrays.calibrated(rows, ["m"], ["label"]), 4)


@query(f"WITH {LONG} SELECT vec_id, i, from_top, from_bottom FROM (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS from_top, row_number() OVER (PARTITION BY vec_id ORDER BY v, i) AS from_bottom FROM l) WHERE from_top <= 5 OR from_bottom <= 5")
def tk02_top_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_and_bottom(long_form(spark, sf_dir), ["vec_id"], "v", "i", 5).select("vec_id", "i", "from_top", "from_bottom")


@query(f"WITH {LONG} SELECT vec_id, count(*) AS n, round(regr_slope(v, ln(i + 1 + 1e-10)), 8) AS slope, round(regr_r2(v, ln(i + 1 + 1e-10)), 8) AS r2 FROM l GROUP BY vec_id")
def kr23_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(arrays.regression(table(spark, sf_dir, "embeddings").withColumn("profile", F.col("embedding").cast("array<double>")), ["vec_id"], "profile"))


_y = "SELECT p_partkey, unnest(CASE WHEN w > h OR w > wd THEN [0] ELSE range(0, h - w + 1, w // 2) END) AS y, h, wd, w FROM s"


@query(f"WITH s AS (SELECT p_partkey, (p_size * 13 + 20)::BIGINT AS h, ((p_partkey % 50) * 11 + 30)::BIGINT AS wd, 128::BIGINT AS w FROM part), y AS ({_y}) SELECT p_partkey, y, unnest(CASE WHEN w > h OR w > wd THEN [0] ELSE range(0, wd - w + 1, w // 2) END) AS x FROM y")
def wn08_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 13 + 20).cast("int").alias("h"), ((F.col("p_partkey") % 50) * 11 + 30).cast("int").alias("w"))
    return ranking.sliding_windows(rows, "h", "w", 128).select("p_partkey", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))


_luma = "[" + ", ".join(map(str, arrays.LUMA)) + "]"
_scale = "CASE WHEN {q} < 50 THEN 5000.0 / {q} ELSE 200.0 - {q} * 2 END"
_table = f"list_transform({_luma}, lambda b: greatest(1, least(255, floor((b * ({_scale}) + 50) / 100)::INT)))"


@query(f"""WITH t AS (SELECT p_partkey, list_transform({_table.format(q="(1 + p_partkey % 100)")}, lambda x: greatest(1, x + (p_size % 3)::INT - 1)) AS t FROM part),
c AS (SELECT q, {_table.format(q="q")} AS c FROM (SELECT unnest(range(1, 101)) AS q)),
e AS (SELECT p_partkey, q, list_sum(list_transform(range(1, 65), lambda i: abs(t[i] - c[i]))) / 64.0 AS error FROM t, c)
SELECT p_partkey, q::INT AS quality, round(error, 8) AS error, error = 0 AS exact FROM e QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY error, q) = 1""")
def kr09_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.transform(arrays.scaled_table((1 + F.col("p_partkey") % 100).cast("int")), lambda x: F.greatest(F.lit(1), x + F.col("p_size") % 3 - 1))
    rows = table(spark, sf_dir, "part").select("p_partkey", own.alias("t"))
    return rounded(arrays.estimated_quality(rows, ["p_partkey"], "t"))


_hist = """s AS (SELECT l_suppkey, abs(round(l_quantity * (1 + l_suppkey % 4)))::BIGINT AS c FROM lineitem), k AS (SELECT l_suppkey, c, count(*) AS k FROM s WHERE c > 1 GROUP BY ALL),
t AS (SELECT l_suppkey, sum(k) AS total, least(100, max(c)) AS longest FROM k GROUP BY l_suppkey), g AS (SELECT l_suppkey, total, unnest(range(1, longest + 1))::INT AS q FROM t),
h AS (SELECT g.l_suppkey, g.q, coalesce(sum(k.k), 0)::DOUBLE / any_value(total) AS share FROM g LEFT JOIN k ON g.l_suppkey = k.l_suppkey AND k.c % g.q = 0 GROUP BY g.l_suppkey, g.q)"""


def coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_quantity") * (1 + F.col("l_suppkey") % 4)).alias("c0"))


@query(f"WITH {_hist} SELECT l_suppkey, coalesce(max(q) FILTER (share >= 0.7), 1) AS step FROM h GROUP BY l_suppkey")
def kr10_factor_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.factor_step(arrays.factor_histogram(coefficients(spark, sf_dir), ["l_suppkey"], "c0"), ["l_suppkey"])


@query(f"WITH {_hist}, r AS (SELECT l_suppkey, share - lag(share) OVER (PARTITION BY l_suppkey ORDER BY q) AS rise FROM h) SELECT l_suppkey, round(coalesce(max(rise), 0), 8) AS sac FROM r GROUP BY l_suppkey")
def kr13_sac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(arrays.sac_score(arrays.factor_histogram(coefficients(spark, sf_dir), ["l_suppkey"], "c0"), ["l_suppkey"]))


@query("SELECT r_regionkey, list_transform(range(0, 256), lambda i: trunc(greatest(0.0, least(255.0, 255.0 * (i - 25) / (230 - 25))))::INT) AS lut FROM region")
def kr19_contrast_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_regionkey", arrays.contrast_lut(20).alias("lut"))


@query("SELECT l_orderkey, l_linenumber, trunc(greatest(0.0, least(255.0, (l_extendedprice - 50000) * 0.005)))::INT AS level FROM lineitem")
def kr20_scaled_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", arrays.scaled_level(F.col("l_extendedprice") - 50000, 0.005).alias("level"))


_fit = "least(1.0, 1024 / greatest(w, h)::DOUBLE)"


@query(f"SELECT p_partkey, greatest(1, least(100, p_size * 3 - 10)) AS quality, greatest(1, floor(w * {_fit})::INT) AS width, greatest(1, floor(h * {_fit})::INT) AS height FROM (SELECT *, (p_partkey * 7 + 1)::INT AS w, (p_size * 90)::INT AS h FROM part)")
def kr22_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (F.col("p_partkey") * 7 + 1).cast("int"), (F.col("p_size") * 90).cast("int")
    width, height = arrays.fitted_size(w, h, 1024)
    return table(spark, sf_dir, "part").select("p_partkey", arrays.quality_clamp(F.col("p_size") * 3 - 10).alias("quality"), width.alias("width"), height.alias("height"))


@query("SELECT n_nationkey, list_transform(range(0, 2 + n_nationkey % 4), lambda y: list_transform(range(0, 3 + n_nationkey % 3), lambda x: CASE WHEN (y % 2 = 0 AND x % 2 = 1) OR (y % 2 = 1 AND x % 2 = 0) THEN 0 ELSE 1 END)) AS map FROM nation")
def kr35_bayer_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = [(F.lit(2) + F.col("n_nationkey") % 4).cast("int"), (F.lit(3) + F.col("n_nationkey") % 3).cast("int")]
    return table(spark, sf_dir, "nation").select("n_nationkey", arrays.bayer_map(*size, "G").alias("map"))


@query(f"WITH {LONG} SELECT vec_id, round(var_pop(v), 8) AS texture FROM l GROUP BY vec_id")
def kr38_texture_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(arrays.texture(long_form(spark, sf_dir), ["vec_id"], "v"))


@query("SELECT o_orderstatus, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 25 ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey")
def so04_dataset_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.ranked(table(spark, sf_dir, "orders"), ["o_orderstatus"], [F.desc("o_totalprice"), F.col("o_orderkey")], "r").filter("r <= 25")
    return rows.orderBy("o_orderstatus", F.desc("o_totalprice"), "o_orderkey").select("o_orderstatus", "o_orderkey", "o_totalprice")


POOLED = "x AS (SELECT label, i, v * 1000 AS v, (vec_id % 13) / 2.0 AS lw FROM l JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id))"


@query(f"""WITH {LONG}, {POOLED}, m AS (SELECT *, max(lw) OVER g AS mw, max(lw + v) OVER g AS mx, max(lw - v) OVER g AS mn FROM x WINDOW g AS (PARTITION BY label, i)),
s AS (SELECT label, i, ln(sum(exp(lw - mw))) + any_value(mw) AS w, ln(sum(exp(lw + v - mx))) + any_value(mx) AS x, ln(sum(exp(lw - v - mn))) + any_value(mn) AS n,
    sum(exp(lw - mw) * v) / sum(exp(lw - mw)) AS mean, sum(exp(lw - mw) * v * v) / sum(exp(lw - mw)) AS msq FROM m GROUP BY label, i)
SELECT label, i, round(w - n, 5) AS soft_min, round(x - w, 5) AS soft_max, round(mean, 5) AS mean, round(msq, 2) AS mean_square FROM s""")
def kr30_weighted_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each place of the embeddings by label, times a thousand: exponentials of which overflow by themselves."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    rows = long_form(spark, sf_dir).join(labels, "vec_id").selectExpr("label", "i", "v * 1000 AS v", "(vec_id % 13) / 2.0D AS lw")
    found = arrays.weighted_pooling(rows, ["label", "i"], "v", "lw")
    return found.select("label", "i", *(F.round(c, 5).alias(c) for c in ("soft_min", "soft_max", "mean")), F.round("mean_square", 2).alias("mean_square"))
