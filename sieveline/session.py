"""Sessions, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, name: str = "sieveline", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only a local session without one gets a temporary folder; on a cluster that
    would be on one machine alone, so there it is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sieveline-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; never a local one, as executors may be lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Named intermediate tables of one query, as Parquet in the shared folder.

    Like checkpoints they cut the lineage, but packed, read by column, and
    dropped as soon as a later table replaces them.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(spark: SparkSession) -> int:
    """Tasks for rows whose work is long beside their bytes: as many as a shuffle has, and one a core at least."""
    return max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers of this session's executors, wherever they run; once a session."""
    if spark.sparkContext.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    packed = f"{tempfile.mkdtemp(prefix='sieveline-')}/sieveline.zip"
    with zipfile.ZipFile(packed, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(packed)
    _shipped.add(spark.sparkContext.applicationId)
