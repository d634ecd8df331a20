"""Joins and set operations between runs, manifests and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.inference import mcnemar_exact, ratio, two_proportions, two_sided
from .metrics import failed


def correctness(records: DataFrame, last: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """model, use_tools, sample_id and ok: whether the last record of each answered rightly.

    An error, an abstention or a missing answer is not right. Trials collapse: the last one counts.
    """
    order = Window.partitionBy("model", "use_tools", "sample_id").orderBy(*(F.desc(c) for c in last))
    ok = (~failed() & F.coalesce(F.col("prediction") == F.col("label"), F.lit(False))).alias("ok")
    rows = records.withColumn("_turn", F.row_number().over(order)).filter("_turn = 1")
    return rows.select("model", "use_tools", "sample_id", ok)


def paired(found: DataFrame) -> DataFrame:
    """Discordant pairs of each model without and with tools, and McNemar's exact p.

    One aggregation by model and sample finds both sides, so the two runs are
    shuffled once and not joined.
    """
    sides = found.groupBy("model", "sample_id").agg(F.max(F.when(~F.col("use_tools"), F.col("ok"))).alias("plain"), F.max(F.when(F.col("use_tools"), F.col("ok"))).alias("tooled"))
    both = sides.filter("plain IS NOT NULL AND tooled IS NOT NULL")
    counted = both.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(F.col("plain") & ~F.col("tooled")).alias("n10"), F.count_if(~F.col("plain") & F.col("tooled")).alias("n01"),
        F.count_if("plain").alias("right_plain"), F.count_if("tooled").alias("right_tooled"),
    )
    return counted.withColumn("p", mcnemar_exact(F.col("n10"), F.col("n01")))


def best_against_rest(ranked: DataFrame) -> DataFrame:
    """Each configuration against the best of its mode with as many rows: pooled z and its p."""
    first = Window.partitionBy("use_tools").orderBy(F.desc("accuracy"), "model")
    best = ranked.withColumns({"best": F.first("accuracy").over(first), "best_n": F.first("total").over(first), "best_model": F.first("model").over(first)})
    rest = best.filter((F.col("model") != F.col("best_model")) & (F.col("total") == F.col("best_n")))
    z = two_proportions(F.col("best"), F.col("best_n"), F.col("accuracy"), F.col("total"))
    return rest.withColumn("z", z).withColumn("p", two_sided(F.col("z")))


def validated(computed: DataFrame, published: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Computed rows beside published ones: found, and the columns that differ by more than the tolerance."""
    other = published.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_found"))
    joined = computed.join(other, keys, "left")

    def differs(c: str) -> Column:
        return F.when(F.col("_found") & ~F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance, F.lit(False)), F.lit(c))

    found = F.coalesce("_found", F.lit(False))
    return joined.select(*keys, found.alias("found"), F.array_compact(F.array(*map(differs, columns))).alias("mismatches"))


def preflight(manifest: DataFrame, files: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a manifest whose file is there, and those whose is not."""
    known = files.select(key).distinct()
    return manifest.join(known, key, "left_semi"), manifest.join(known, key, "left_anti")


def upserted(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A keyed table after changes: of rows with one key the latest, those of changes before those of the table."""
    rows = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    return rows.withColumn("_turn", F.row_number().over(last)).filter("_turn = 1").drop("_turn", "_new")


def deleted(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys, on, "left_anti")


def cached(wanted: DataFrame, cache: DataFrame, keys: list[str], compute) -> DataFrame:
    """Rows of the cache for what is wanted, and ``compute`` of the keys that it lacks; failures are not kept."""
    good = cache.filter("status <> 'error'")
    hits = wanted.join(good, keys)
    return hits.unionByName(compute(wanted.join(good, keys, "left_anti")), allowMissingColumns=True)


def filter_results(
    records: DataFrame, model: str | None = None, use_tools: bool | None = None, prediction: str | None = None, label: str | None = None, correct: bool | None = None
) -> DataFrame:
    """Records by model substring (any case), mode, prediction, label and correctness (null-safe)."""
    wanted = F.lit(True)
    if model is not None:
        wanted &= F.contains(F.lower("model"), F.lit(model.lower()))
    for name, value in (("use_tools", use_tools), ("prediction", prediction), ("label", label)):
        if value is not None:
            wanted &= F.col(name) == value
    if correct is not None:
        wanted &= F.col("prediction").eqNullSafe(F.col("label")) == correct
    return records.filter(wanted)


def mismatches(checked: DataFrame, keys: list[str], k: int = 25) -> DataFrame:
    """The first k mismatching values of a validation, by key and column: what a report shows."""
    return checked.select(*keys, F.explode("mismatches").alias("column")).orderBy(*keys, "column").limit(k)


def first_config_file(results: DataFrame, keys: list[str], file: str = "file_name") -> DataFrame:
    """The file that holds each configuration's records: the first by name."""
    return results.groupBy(*keys).agg(F.min(file).alias(file))


def clamped_index(wanted: Column, n: Column) -> Column:
    """A place in a list of n, or the nearest to it; 0 for an empty list."""
    return F.greatest(F.lit(0), F.least(wanted, n - 1))


def review_summary(reviews: DataFrame) -> DataFrame:
    """Reviews with a mean quality, and how many call the reasoning valid, suspect fabrication, agree, or found tools read rightly."""
    flags = {"valid": "reasoning_valid", "fabricated": "fabrication_suspected", "agree": "verdict_agree", "tools_right": "tool_interpretation_correct"}
    return reviews.agg(F.count("*").alias("reviews"), F.round(F.avg("reasoning_quality"), 8).alias("mean_quality"), *(F.count_if(c).alias(n) for n, c in flags.items()))


def unique_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column in the order of their text."""
    return df.select(column).distinct().orderBy(F.col(column).cast("string"))


def progress(samples: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """How many samples have a review, how many have not, and the percentage."""
    marked = samples.select(key).distinct().join(reviews.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
    counted = marked.agg(F.count("*").alias("total"), F.count("_done").alias("done"))
    return counted.select("total", "done", (F.col("total") - F.col("done")).alias("left"), F.round(100 * ratio(F.col("done"), F.col("total")), 8).alias("percent"))
