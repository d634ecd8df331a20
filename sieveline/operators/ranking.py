"""Rankings, windows and order-defined choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_checkpoint


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Rows numbered from 1 in each group; the order must tell all rows apart."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def delta_to_best(df: DataFrame, by: list[str], value: str, key: str) -> DataFrame:
    """Each row's value, the best of its group and the difference."""
    first = Window.partitionBy(*by).orderBy(F.desc(value), key)
    return df.withColumn("best", F.first(value).over(first)).withColumn("delta", F.col("best") - F.col(value))


def last_write(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return ranked(df, keys, order, "_turn").filter("_turn = 1").drop("_turn")


def chunked(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Rows with the _chunk that holds them: ranges of group and order, each sorted apart, so a group may lie in many.

    The chunks are written down, as ranges of a rerun may be cut elsewhere.
    """
    ranged = df.repartitionByRange(*map(F.col, by), *order).withColumn("_chunk", F.spark_partition_id())
    return shared_checkpoint(ranged)


def beside(rows: DataFrame, chunks: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of their group and chunk (named with a _ behind), nulls being groups too."""
    named = chunks.select(*(F.col(c).alias(f"{c}__") for c in [*by, "_chunk"]), *(c for c in chunks.columns if c not in by and c != "_chunk"))
    same = F.lit(True)
    for c in [*by, "_chunk"]:
        same &= rows[c].eqNullSafe(named[f"{c}__"])
    return rows.join(named, same).drop(*(f"{c}__" for c in [*by, "_chunk"]))


def placed(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str], total: str) -> DataFrame:
    """Rows with running sums in the order of their group, and the group's sum of one of them.

    ``sums`` names the columns that are summed up; the order must tell rows
    apart. Sums run in ranges that tasks share out whatever the number of groups;
    what comes before a range is a sum of a row a range.
    """
    rows = chunked(df, by, order)
    chunks = rows.groupBy(*by, "_chunk").agg(*(F.sum(c).alias(f"_{name}") for name, c in sums.items()))
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = (F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums)
    chunks = chunks.select(*by, "_chunk", *before, F.sum(f"_{total}").over(Window.partitionBy(*by)).alias("_total"))
    within = Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = beside(rows, chunks, by)
    running = {name: F.col(f"_{name}") + F.sum(c).over(within) for name, c in sums.items()}
    return found.withColumns(running).withColumnRenamed("_total", f"all_{total}").drop("_chunk", *(f"_{name}" for name in sums))


def top_and_bottom(df: DataFrame, by: list[str], value: str, key: str, k: int) -> DataFrame:
    """The k largest and the k smallest rows of each group, with their places; ties by key.

    Two limits by group, each of which leaves k rows a task before its shuffle. A
    row's place from the other end follows from its place, the rows of its group
    and those that tie with it. The keys must tell a group's rows apart.
    """
    tied = df.groupBy(*by, value).agg(F.count("*").alias("_t"))
    tied = tied.select(*(F.col(c).alias(f"{c}__") for c in [*by, value]), "_t", F.sum("_t").over(Window.partitionBy(*by)).alias("_n"))
    ends = []
    for name, other, order in (("from_top", "from_bottom", F.desc(value)), ("from_bottom", "from_top", F.asc(value))):
        first = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order, key))).filter(F.col(name) <= k)
        # those that tie with a row and come before it are among the first as well
        first = first.withColumn("_r", F.row_number().over(Window.partitionBy(*by, value).orderBy(key)))
        same = F.lit(True)
        for c in [*by, value]:
            same &= first[c].eqNullSafe(tied[f"{c}__"])
        placed_ = first.join(tied, same).withColumn(other, (F.col("_n") - F.col(name) - F.col("_t") + 2 * F.col("_r")).cast("int"))
        ends.append(placed_.select(*df.columns, "from_top", "from_bottom"))
    return ends[0].unionByName(ends[1].filter(F.col("from_top") > k))


def next_open(df: DataFrame, by: list[str], index: str, done: str) -> DataFrame:
    """For each row the next one after it that is not done, wrapping to the group's first; null if all are done.

    The first open row of each range is carried back over the ranges before it,
    so rows are ordered in their range alone.
    """
    open_ = F.when(~F.col(done), F.col(index))
    rows = chunked(df, by, [F.col(index)])
    chunks = rows.groupBy(*by, "_chunk").agg(F.min(open_).alias("_first"))
    later = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    carried = F.coalesce(F.min("_first").over(later), F.min("_first").over(Window.partitionBy(*by))).alias("_carried")
    chunks = chunks.select(*by, "_chunk", carried)
    # seen from the last row, those after are those before: a frame that grows row by row
    after = Window.partitionBy(*by, "_chunk").orderBy(F.desc(index)).rowsBetween(Window.unboundedPreceding, -1)
    found = beside(rows, chunks, by).withColumn("next_open", F.coalesce(F.min(open_).over(after), "_carried"))
    return found.select(*df.columns, "next_open")


def sliding_windows(df: DataFrame, height: str, width: str, window: int) -> DataFrame:
    """Origins of square windows that overlap by half; one at the origin for an image that is smaller."""
    small = (F.lit(window) > F.col(height)) | (F.lit(window) > F.col(width))
    stride = max(1, window // 2)

    def starts(size: str) -> Column:
        return F.when(small, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.col(size) - window, F.lit(0)).cast("int"), F.lit(stride)))

    return df.withColumn("y", F.explode(starts(height))).withColumn("x", F.explode(starts(width)))


def flattened(df: DataFrame, folder: str, name: str, order: str) -> DataFrame:
    """Files of many folders under names of one: the first of a name keeps it, the others are named after their folder as well.

    ``order`` tells rows apart. A name's first place is an aggregate, so a name
    that many folders have is not put in order in one task.
    """
    firsts = df.groupBy(name).agg(F.min(order).alias("_first")).select(F.col(name).alias("_name"), "_first")
    both = df.join(firsts, df[name].eqNullSafe(firsts["_name"]))
    return both.withColumn("flat_name", F.when(F.col(order) > F.col("_first"), F.concat(folder, F.lit("_"), name)).otherwise(F.col(name))).drop("_name", "_first")


def outliers(df: DataFrame, by: list[str], z: str, bound: float, key: str) -> DataFrame:
    """Rows whose z passes the bound, with the side and their place on it: the lowest and the highest first.

    Places are counted over ranges that tasks share, as there are two sides a
    group whatever its rows.
    """
    side = F.when(F.col(z) < -bound, "low").when(F.col(z) > bound, "high")
    rows = df.withColumns({"side": side, "_one": F.lit(1)}).filter("side IS NOT NULL")
    found = placed(rows, [*by, "side"], [F.desc(F.abs(z)), F.col(key)], {"place": "_one"}, "place")
    return found.withColumn("place", F.col("place").cast("int")).select(*df.columns, "side", "place")


def seeded_order(key: str, seed: str) -> Column:
    """A shuffled order that any run repeats: a hash of seed and key."""
    return F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)


def sampled(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows without replacement, the first by the seeded order."""
    return df.orderBy(seeded_order(key, seed), key).limit(n)


def numbered(df: DataFrame, order: list[Column], form: str = "ffpp-%05d", name: str = "id") -> DataFrame:
    """Rows with ids numbered from 1 in a global order.

    Ranges are sorted apart and their sizes added up, so no task sees all rows.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    parts = shared_checkpoint(parts)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    joined = parts.join(F.broadcast(sizes.withColumn("_before", before)), "_part")  # one row a partition
    number = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return joined.withColumn(name, F.format_string(form, number)).drop("_part", "_at", "_n", "_first", "_before")
