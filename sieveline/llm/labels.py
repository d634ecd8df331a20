"""Folds by id, bounded samples of labelled rows, and sums of tables of fixed size over all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import tidy

#: Groups of tasks whose tables are added up before the groups' own are.
LANES = 32
SUMS = "part int, lane int, sums binary"


def fold(key: str, of: int) -> Column:
    """crc32 of an id as text, modulo a number; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % of


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int, only: int | None = None) -> DataFrame:
    """doc_id, text and label of at most ``bound`` labelled learning rows, in order of a hash of the id.

    Rows of the held-out fold (remainder 0 of 5) and null labels are never read
    further. The ids are bounded before the join, so they may be broadcast. An id
    that many rows have counts once, with the least of its texts.
    """
    found = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).filter((fold("doc_id", 5) != 0) & F.col("label").isNotNull())
    if only is not None:
        found = found.filter(F.col("label") == only)
    chosen = found.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(bound)
    return once(docs, chosen.distinct())


def once(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of a bounded table of ids, each with the least of its texts; a null text counts as empty."""
    texts = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").groupBy(*ids.columns).agg(F.min("text").alias("text"))


def partial_sums(parts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    """A task's parts of a table of whole numbers, as rows of SUMS."""
    lane = TaskContext.get().partitionId() % LANES
    columns = [pa.array([i for i, _ in parts], pa.int32()), pa.array([lane] * len(parts), pa.int32()), pa.array([x.tobytes() for _, x in parts], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["part", "lane", "sums"])


def summed(partial: DataFrame, parts: int) -> dict[int, np.ndarray]:
    """The sums of each part over all tasks' rows of SUMS.

    Added up within groups of tasks first, so that no task reads a part of every
    task; the driver reads one row a part, of fixed size.
    """

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, lane, raw in zip(batch.column("part").to_pylist(), batch.column("lane").to_pylist(), batch.column("sums"), strict=True):
                sums[part, lane] = sums.get((part, lane), 0) + np.frombuffer(raw.as_buffer(), np.int64)
        columns = [pa.array([k[i] for k in sums], pa.int32()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "lane", "sums"])

    grouped = partial.repartition("part", "lane").mapInArrow(add, SUMS).withColumn("lane", F.lit(0))
    rows = grouped.repartition(parts, "part").mapInArrow(add, SUMS).collect()
    return {row.part: np.frombuffer(row.sums, np.int64) for row in rows}
