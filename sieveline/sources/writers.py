"""Writers of records, metric documents, manifests, reviews and Markdown."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fixed, markdown_cell


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines in UTF-8; nulls are left out."""
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def metrics_json(metrics: DataFrame, keys: tuple[str, ...] = ("model", "mode")) -> DataFrame:
    """One JSON text for each configuration, named ``model|mode``."""
    values = [c for c in metrics.columns if c not in keys]
    return metrics.select(F.to_json(F.struct(F.concat_ws("|", *keys).alias("config"), *values)).alias("value"))


def write_metrics(metrics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    metrics_json(metrics).write.mode(mode).text(path)


def cell(df: DataFrame, name: str) -> Column:
    """A table cell: floating numbers with three digits."""
    kind = dict(df.dtypes)[name]
    return markdown_cell(fixed(F.col(name), 3) if kind in ("double", "float") else F.col(name).cast("string"))


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as the line of a Markdown table; cells may not be null, so none is dropped."""
    return df.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(df, c) for c in columns)), F.lit(" |")))


def markdown_table(df: DataFrame, columns: list[tuple[str, str]], order: list[str]) -> str:
    """A Markdown table of a small result: headers, a rule and a line for each row, in order."""
    head = "| " + " | ".join(title for _, title in columns) + " |"
    rule = "|" + "|".join(":---:" if i == 0 else "---" for i in range(len(columns))) + "|"
    rows = markdown_rows(df, [name for name, _ in columns]).orderBy(*order).select("line").toLocalIterator()
    return "\n".join([head, rule, *(r.line for r in rows)])


def write_cache(rows: DataFrame, path: str) -> None:
    """Tool outputs added to a cache; failed ones are not. A file appears whole or not at all."""
    rows.filter("status <> 'error'").write.mode("append").json(path)


def clear_cache(spark: SparkSession, path: str) -> int:
    """Take all entries of a cache away; how many there were."""
    held = spark.read.schema("tool string").json(path)
    n = held.count()
    held.limit(0).write.mode("overwrite").json(path)
    return n


#: Published versions of a document that stay for readers that hold one.
VERSIONS = 8


def _versions(spark: SparkSession, path: str) -> tuple[object, object, list[tuple[int, str]]]:
    """File system and folder of a document, and its published versions (number, id), the last one last."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    parts = [n.split("-") for n in names if n.startswith("_current-")]
    return files, folder, sorted((int(p[1]), p[2]) for p in parts)


def save_whole(df: DataFrame, path: str) -> None:
    """A document at a plain path, for readers that know nothing of versions.

    The old one is moved aside, not deleted, until the new one is in its place, so
    a crash loses neither; a reader may see nothing for that moment. ``publish``
    has no such moment.
    """
    place = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    target, beside, aside = place(path), place(f"{path}.{uuid.uuid4().hex}"), place(f"{path}.{uuid.uuid4().hex}.old")
    files = target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    df.write.json(beside.toString())
    held = files.exists(target)
    if held and not files.rename(target, aside):
        raise OSError(f"{path} could not be moved aside")
    if not files.rename(beside, target):
        if held:
            files.rename(aside, target)
        raise OSError(f"{beside} could not be moved to {path}")
    files.delete(aside, True)


def publish(df: DataFrame, path: str, versions: int = VERSIONS) -> None:
    """A document replaced in two phases: its rows are written apart, then an empty marker publishes them.

    The marker is one file that is created last and never changed, so readers
    (``current``) see the version before or this one, whole. A write that fails
    takes its rows away and leaves the version before. The last ``versions`` stay
    for readers that hold one.
    """
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    own = uuid.uuid4().hex
    rows = place(f"{path}/_rows-{own}")
    files = rows.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.json(rows.toString())
    except Exception:
        files.delete(rows, True)
        raise
    published = _versions(spark, path)[2]
    number = published[-1][0] + 1 if published else 0
    files.create(place(f"{path}/_current-{number:012d}-{own}"), False).close()
    for n, old in published[: max(0, len(published) + 1 - max(1, versions))]:
        files.delete(place(f"{path}/_current-{n:012d}-{old}"), True)
        files.delete(place(f"{path}/_rows-{old}"), True)


def current(spark: SparkSession, path: str) -> str:
    """The folder of a document's last published version; the path itself for one that was never saved so."""
    published = _versions(spark, path)[2]
    return f"{path}/_rows-{published[-1][1]}" if published else path


def cache_stats(cache: DataFrame) -> DataFrame:
    """Entries, bytes and MB of a cache."""
    counted = cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("output")), F.lit(0)).alias("bytes"))
    return counted.withColumn("mb", F.bround(F.col("bytes") / (1024.0 * 1024.0), 2))


def manifest_rows(files: DataFrame, form: str = "ffpp-%05d") -> DataFrame:
    """id, image and label of files by path and label, numbered from 1, with forward slashes."""
    from ..operators.ranking import numbered

    clean = files.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("image"), "label")
    return numbered(clean, [F.col("image"), F.col("label")], form).select("id", "image", "label")


def appended_manifest(manifest: DataFrame, files: DataFrame, prefix: str = "sample-", width: int = 6) -> DataFrame:
    """Rows for files that a manifest lacks, numbered on from its largest number, by path."""
    from ..operators.ranking import numbered

    fresh = files.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("image"), "label").join(manifest.select("image"), "image", "left_anti")
    placed = numbered(fresh, [F.col("image"), F.col("label")], "%d", "_number")
    number = F.col("_number").cast("long") + F.col("next") - 1
    found = placed.crossJoin(F.broadcast(next_number(manifest, prefix)))  # one row
    return found.select(F.format_string(f"{prefix}%0{width}d", number).alias("id"), "image", "label")


def next_number(manifest: DataFrame, prefix: str = "sample-") -> DataFrame:
    """One more than the largest number of ids with a prefix; 1 without any."""
    number = F.regexp_extract("id", f"^{prefix}(\\d+)$", 1).try_cast("long")
    return manifest.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))
