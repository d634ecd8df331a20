"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A document's whole copies, the integer part
of target / source size, are certain. The rest of a source's target is drawn by
Pareto order sampling. A document's probability to be drawn once more grows with
its size, and the probabilities are such that the words drawn are expected to be
the rest: p = min(1, c * size) with sum(p * size) = rest, where those at 1 are
certain and taken out before c is set for the others. A document's random odds
u / (1 - u), divided by its inclusion odds p / (1 - p), rank it. The sample's
fixed size is the rest in words: documents enter in rank order until one would
pass the rest by more than the slack, a small part of the target. The draw then
goes on with the documents that still fit, in as many rounds as it takes, until
the total is within the slack or none fits. Then the least document is taken if
that brings the total nearer. So a document that is larger than the rest and the
slack together is in no sample but as this last one.

The random number is a hash of the seed and the id, so reruns and recomputed
partitions agree. A draw is described by one small row a source: for every round
the sizes that could enter and the last rank that did. Ranks of the last
documents are found by a histogram of rank bins in each source and an order of
the rows in one bin alone, so no source is ever gathered in one task, and texts
are never shuffled: whether a document is drawn follows from its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_checkpoint

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3.0
WEIGHTS = (1.0, 2.0, 3.0)
#: By which part of its target a source's total may pass it.
SLACK = 0.0025
#: Bins in each unit of the logarithm of a rank.
BINS = 256
#: Sources that are broadcast, at most; more are joined by salted keys.
SOURCES = 20_000
SALTS = 32
#: 13 hex digits of the hash: 52 bits, exact in a double.
SCALE = float(16**13)


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, share: float = 1.0) -> DataFrame:
    """source, source_size, weight and target of every source, from (source, source_size).

    Sources in order of code points, null last, weigh ``weights`` in turn. A
    target stops at ``most`` times its source's size; the excess is shared again
    by weight among the rest. With sources in order of the fill level
    most * size / weight at which they stop, those that stop are a prefix, so one
    ordered pass finds the level. The rows are one a source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    level = F.col("source_size") * F.lit(most) / F.col("weight")
    fill = Window.orderBy("level", F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    shared = (
        weighed.withColumn("level", level)
        .withColumn("capped", F.coalesce(F.sum(F.col("source_size")).over(before), F.lit(0)) * F.lit(most))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("fill", (F.col("total") - F.col("capped")) / F.col("open"))
    )
    # the first source, in this order, whose own level is not below the fill sets the level of the rest
    shared = shared.withColumn("water", F.min(F.when(F.col("fill") <= F.col("level"), F.struct("level", "fill"))).over(every))
    target = F.when(
        F.col("water").isNull() | (F.col("level") < F.col("water.level")), F.col("source_size") * F.lit(most)
    ).otherwise(F.least(F.col("weight") * F.col("water.fill"), F.col("source_size") * F.lit(most)))
    return shared.select("source", "source_size", "weight", target.cast("double").alias("target"))


def random_number(seed: str) -> Column:
    """A number in (0, 1) from a row's id, or its text without one."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key)), 1, 13), 16, 10)
    return (u.cast("double") + 0.5) / SCALE


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, share: float = 1.0, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies * size) of every row.

    A null or empty text has size 0 and no copies; a null source is a source of
    its own, last in order. A row without id is drawn by its text. Rows of one
    source with equal ids (or texts, without ids) and sizes are drawn together.
    Extra columns are left out, whatever their names. An empty table gives no
    rows. If every text is empty, every target is 0.
    """
    rows = shared_checkpoint(_numbered(docs, seed))
    drawn = _ranked(_with_sources(rows, *draw(rows, weights, most, share)))
    return drawn.select("doc_id", "source", "size", "source_size", "target", _copies().alias("copies"), (_copies() * F.col("size")).alias("taken"))


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, share: float = 1.0, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of docs, all its columns, as often as ``mix`` takes it. Texts are not shuffled."""
    sources = draw(shared_checkpoint(_numbered(docs, seed)), weights, most, share)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    whole = docs.select(row, "doc_id", "source", n_words().alias("size"), random_number(seed).alias("u"))
    drawn = _ranked(_with_sources(whole, *sources)).withColumn("copies", _copies()).filter("copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def _numbered(docs: DataFrame, seed: str) -> DataFrame:
    return docs.select("doc_id", "source", n_words().alias("size"), random_number(seed).alias("u"))


def _with_sources(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """rows beside their source's row: a broadcast of a checked number of rows, or else a join in which a source is dealt over many tasks."""
    if few:
        return rows.join(F.broadcast(sources), rows["source"].eqNullSafe(sources["source_"]))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)))
    every = sources.withColumn("_salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, salted["source"].eqNullSafe(every["source_"]) & (F.col("_salt") == F.col("_salt_"))).drop("_salt", "_salt_")


def _ranked(rows: DataFrame) -> DataFrame:
    """p, rank (random odds by inclusion odds; 0 for the certain) and bin of rows beside their sources."""
    p = F.when(F.col("slope").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.col("slope") * F.col("size")))
    rank = F.when(F.col("p") >= 1, 0.0).when(F.col("p") > 0, F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p"))))
    # the logarithm keeps the order of ranks, so bins are ranges of ranks
    return rows.withColumn("p", p).withColumn("rank", rank).withColumn("bin", F.when(F.col("rank") > 0, F.floor(F.log("rank") * BINS)).otherwise(-(1 << 30)).cast("int"))


def _place() -> Column:
    return F.struct("rank", "doc_id", "size")


def _extra() -> Column:
    """Whether some round of a row's source drew it."""
    at = F.col("bin")
    return F.exists("rounds", lambda r: (F.col("size") < r["below"]) & ((at < r["bin"]) | ((at == r["bin"]) & F.coalesce(_place() <= r["last"], F.lit(False)))))


def _copies() -> Column:
    drawn = F.col("whole") + F.when(_extra(), 1).otherwise(0)
    return F.when(F.col("size") > 0, drawn).otherwise(0).cast("long")


def _kept(sources: DataFrame, few: bool) -> DataFrame:
    """A table of a row a source, cut off from its lineage: as local rows if their checked number is small, else as a checkpoint."""
    return sources.sparkSession.createDataFrame(sources.toArrow(), sources.schema) if few else shared_checkpoint(sources)


def _fits() -> Column:
    return (F.col("size") > 0) & (F.col("size") < F.col("below"))


def _below(rest: Column) -> Column:
    """Sizes below this pass the rest by the slack at most, and leave the total nearer to it."""
    return F.least(2 * rest, F.floor(rest + SLACK * F.col("target")) + 1.0)


def draw(rows: DataFrame, weights: tuple[float, ...], most: float, share: float) -> tuple[DataFrame, bool]:
    """One row a source: source_, source_size, target, whole copies, slope of the inclusion probabilities, and rounds; and whether they are few.

    A round says below which size documents could enter, the bin of the last
    rank that entered, and its place; a null place is none of that bin.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    few = sizes.limit(SOURCES + 1).count() <= SOURCES
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + F.lit(1e-12)).cast("long")
    rest = F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))
    aimed = targets(sizes, weights, most, share).withColumnRenamed("source", "source_").withColumn("whole", whole).withColumn("rest", rest)
    aimed = _kept(aimed.withColumn("below", _below(F.col("rest"))), few)
    place = f"array<struct<below:double,bin:int,last:struct<rank:double,doc_id:{kind},size:bigint>>>"
    state = _joined(aimed, _slopes(rows, aimed, few)).withColumns({"rounds": F.array().cast(place), "went": F.lit(True)})
    state = _kept(state, few)
    while not state.filter("went AND below > 1").isEmpty():
        state = _kept(_round(rows, state, few), few)
    if not state.filter(F.col("rest") > SLACK * F.col("target")).isEmpty():
        state = _kept(_nearest(rows, state, few), few)
    return state, few


def _joined(sources: DataFrame, more: DataFrame) -> DataFrame:
    """sources with the columns of a table by ``_source``, both a row a source at most."""
    return sources.join(more, sources["source_"].eqNullSafe(more["_source"]), "left").drop("_source")


def _slopes(rows: DataFrame, aimed: DataFrame, few: bool) -> DataFrame:
    """_source and slope: what a size is multiplied by for its inclusion probability; none if all are certain.

    From the numbers of documents of each size: of N words in a source there are
    fewer than sqrt(2 N) sizes. Sizes in falling order are certain until the
    first whose probability, with the larger ones taken out, is 1 at most.
    """
    fit = _with_sources(rows, aimed, few).filter(_fits())
    sizes = fit.groupBy(F.col("source_").alias("_source"), "size").agg(F.count("*").alias("n"), F.any_value("rest").alias("rest"))
    falling = Window.partitionBy("_source").orderBy(F.desc("size"))
    larger = F.coalesce(F.sum(F.col("n") * F.col("size")).over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    square = F.col("n").cast("decimal(38,0)") * F.col("size") * F.col("size")
    squares = F.sum(square.cast("decimal(38,0)")).over(falling.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    slope = sizes.withColumn("slope", (F.col("rest") - larger) / squares).filter("slope * size <= 1")
    return slope.groupBy("_source").agg(F.max_by("slope", "size").alias("slope"))


def _round(rows: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """Draw once more in every source: what fits, in rank order, until the rest is passed by more than the slack."""
    open_ = _ranked(_with_sources(rows, state, few)).filter(_fits() & ~_extra())
    bins = open_.groupBy("source_", "bin").agg(F.sum("size").alias("words"), F.any_value("rest").alias("rest"))
    upto = F.sum("words").over(Window.partitionBy("source_").orderBy("bin"))
    passing = F.when(F.col("upto") > F.col("rest"), F.struct("bin", (F.col("upto") - F.col("words")).alias("under")))
    cut = bins.withColumn("upto", upto).groupBy(F.col("source_").alias("_source")).agg(F.min(passing).alias("cut"), F.sum("words").alias("all"))
    cut = _kept(cut, few)
    # rows are ordered one by one in the bin alone in which the rest is passed
    at = _joined(state, cut.select("_source", "cut")).filter("cut IS NOT NULL")
    units = _ranked(_with_sources(rows, at, few)).filter(_fits() & (F.col("bin") == F.col("cut.bin")) & ~_extra())
    held = (F.any_value(c).alias(name) for c, name in (("rest", "rest"), ("target", "target"), ("cut.under", "under")))
    units = units.groupBy("source_", "rank", "doc_id", "size").agg(F.sum("size").alias("words"), *held)
    order = Window.partitionBy("source_").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    over = F.col("under") + F.sum("words").over(order) - F.col("rest")
    units = units.withColumn("over", over)
    enters = units.filter((F.col("over") <= 0) | ((F.col("over") <= SLACK * F.col("target")) & (F.col("over") < F.col("words") - F.col("over"))))
    last = enters.groupBy(F.col("source_").alias("_source")).agg(F.max(_place()).alias("last"), F.sum("words").alias("in_bin"))
    words = F.when(F.col("cut").isNull(), F.coalesce("all", F.lit(0))).otherwise(F.col("cut.under") + F.coalesce("in_bin", F.lit(0)))
    return _drawn(state, _joined(_joined(state, cut), last).withColumn("words", words), F.coalesce("cut.bin", F.lit((1 << 31) - 1)))


def _nearest(rows: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """The least document left in each source, the first in rank order of its size, where it brings the total nearer."""
    short = state.filter(F.col("rest") > SLACK * F.col("target")).withColumn("below", 2 * F.col("rest"))
    place = F.struct("size", "rank", "doc_id", "bin")
    open_ = _ranked(_with_sources(rows, short, few)).filter(_fits() & ~_extra())
    units = open_.groupBy("source_", "size", "rank", "doc_id", "bin").agg(F.sum("size").alias("words"))
    least = units.groupBy(F.col("source_").alias("_source")).agg(F.min(place).alias("least"), F.min_by("words", place).alias("words"))
    found = _joined(state, least).withColumn("words", F.when(F.col("words") < 2 * F.col("rest"), F.col("words")).otherwise(0))
    last = F.struct("least.rank", "least.doc_id", "least.size").alias("last")
    return _drawn(state, found.withColumns({"last": last, "below": F.col("least.size") + 1.0}), F.col("least.bin"))


def _drawn(state: DataFrame, found: DataFrame, last_bin: Column) -> DataFrame:
    """The sources after a round that drew so many words below a size, up to a bin and the last place in it."""
    rounds = F.when(F.col("words") > 0, F.concat("rounds", F.array(F.struct("below", last_bin.alias("bin"), "last")))).otherwise(F.col("rounds"))
    rest = F.col("rest") - F.col("words")
    found = found.withColumn("rounds", rounds).withColumns({"went": F.col("words") > 0, "rest": rest, "below": _below(rest)})
    return found.select(state.columns)


def sql(rounds: int = 24) -> str:
    """DuckDB SQL of the query: the same draw with plain running sums in each source, in more rounds than any source needs."""
    below, steps = f"least(2 * rest, floor(rest + {SLACK} * target) + 1)", []
    for i in range(rounds):
        steps.append(f"""
f{i} AS (SELECT *, NOT drawn AND size > 0 AND size < {below} AS fits FROM d{i}),
g{i} AS (SELECT *, sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST, size) - rest AS over,
    sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source, rank, doc_id, size) AS own FROM f{i}),
e{i} AS (SELECT *, fits AND (over <= 0 OR (over <= {SLACK} * target AND over < own - over)) AS enters FROM g{i}),
d{i + 1} AS (SELECT doc_id, source, size, source_size, target, whole, rank, drawn OR enters AS drawn,
    rest - sum(CASE WHEN enters THEN size ELSE 0 END) OVER (PARTITION BY source) AS rest FROM e{i})""")
    steps.append(f"""
f AS (SELECT *, NOT drawn AND size > 0 AND size < 2 * rest AND rest > {SLACK} * target AS fits FROM d{rounds}),
g AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY NOT fits, size, rank, doc_id NULLS FIRST) AS turn,
    sum(size) OVER (PARTITION BY source, fits, rank, doc_id, size) AS own FROM f),
d AS (SELECT *, drawn OR (fits AND turn = 1 AND own < 2 * rest) AS taken_once FROM g)""")
    return f"""
WITH docs AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, text, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / {SCALE!r} AS u FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size,
    [{", ".join(map(repr, WEIGHTS))}]::DOUBLE[] AS ws FROM docs GROUP BY source),
turned AS (SELECT source, source_size, ws[1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)}] AS weight FROM sources),
levels AS (SELECT *, source_size * {MOST} / weight AS level FROM turned),
filled AS (SELECT *, (sum(source_size) OVER ()::DOUBLE
      - coalesce(sum(source_size) OVER (ORDER BY level, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * {MOST})
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY level, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS fill FROM levels),
water AS (SELECT min(level) AS level, arg_min(fill, level) AS fill FROM filled WHERE fill <= level),
aimed AS (SELECT source, source_size, CASE WHEN w.level IS NULL OR f.level < w.level THEN source_size * {MOST}
    ELSE least(weight * w.fill, source_size * {MOST}) END::DOUBLE AS target FROM filled f, water w),
ratios AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM aimed),
wholes AS (SELECT source, source_size, target, floor(ratio + 1e-12)::BIGINT AS whole, greatest(target - floor(ratio + 1e-12) * source_size, 0) AS rest FROM ratios),
beside AS (SELECT d.*, source_size, target, whole, rest FROM docs d JOIN wholes w ON d.source IS NOT DISTINCT FROM w.source),
sizes AS (SELECT source, size, count(*) AS n, any_value(rest) AS rest FROM beside WHERE size > 0 AND size < {below} GROUP BY source, size),
sloped AS (SELECT source, size, (rest - coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(n::HUGEINT * size * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS slope FROM sizes),
slopes AS (SELECT source, arg_max(slope, size) AS slope FROM sloped WHERE slope * size <= 1 GROUP BY source),
odds AS (SELECT b.*, CASE WHEN slope IS NULL THEN 1.0 ELSE least(1.0, slope * size) END::DOUBLE AS p FROM beside b LEFT JOIN slopes s ON b.source IS NOT DISTINCT FROM s.source),
d0 AS (SELECT doc_id, source, size, source_size, target, whole, rest, false AS drawn,
    CASE WHEN p >= 1 THEN 0.0 WHEN p > 0 THEN u / (1 - u) / (p / (1 - p)) END::DOUBLE AS rank FROM odds),
{",".join(steps)}
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN (whole + taken_once::BIGINT) * size ELSE 0 END)::BIGINT AS taken FROM d"""
