"""Document fingerprints: threshold-scaled sketches of code-point shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so
its size follows the document's, sketches of parts merge by union, and the share
of one sketch found in another estimates containment even where a passage is
compared with a book. Only a document with no hash below the threshold keeps its
least hash instead, so that short texts can be told apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shuffle_partitions
from .text import U64, mix, tidy

#: Code points in a shingle, and one hash of how many is kept.
LENGTH = 12
SCALE = 16
#: Ranges of ids for each shuffle partition: several, so that tasks are even.
RANGES = 4
#: Bytes of text in a range, about; and how many ranges there are at most, and ids drawn for each.
RANGE_BYTES = 16 << 20
MOST_RANGES = 1 << 16
DRAWS = 16
#: Code points of a text by which rows of one id are dealt over ranges.
HEAD = 32
_ODD = 0x9E3779B97F4A7C15


def shingle_hashes(points: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A hash of every shingle of an array of code points; a shorter text is one shingle."""
    n = len(points)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(n, length)
    one = mix(points.astype(np.uint64) + U64(1))
    total, have, size = None, 0, 1
    power = one  # hashes of runs of `size` points
    while size <= k:
        if k & size:
            room = n - have - size + 1
            tail = power[have : have + room]
            shift = U64(pow(_ODD, size, 1 << 64))
            total = tail if total is None else total[:room] * shift + tail
            have += size
        if size * 2 <= k:
            power = power[:-size] * U64(pow(_ODD, size, 1 << 64)) + power[size:]
        size *= 2
    return mix(total + U64(k))


def sketch(text: str, length: int = LENGTH, scale: int = SCALE) -> np.ndarray:
    """The sorted distinct hashes kept of a whole text; empty for an empty text."""
    hashes = shingle_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), length)
    kept = hashes[hashes < U64((1 << 64) // scale)]
    return np.unique(kept) if len(kept) else hashes.min(keepdims=True) if len(hashes) else hashes


def merge(sketches: list[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """The sketch of several texts together."""
    every = np.unique(np.concatenate(sketches)) if sketches else np.zeros(0, np.uint64)
    kept = every[every < U64((1 << 64) // scale)]
    return kept if len(kept) else every[:1]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes by all hashes; 1 for two empty sketches."""
    both = shared(a, b)
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of the first document's shingles in the second; 1 if the first is empty."""
    return shared(a, b) / len(a) if len(a) else 1.0


def contained(a: Column, b: Column) -> Column:
    """containment() of two sketch columns, as an expression."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def digest(kept: np.ndarray) -> str:
    return hashlib.sha256(kept.astype("<u8").tobytes()).hexdigest()


def sketches(docs: DataFrame, text: str = "text", length: int = LENGTH, scale: int = SCALE) -> DataFrame:
    """doc_id and sketch (array of long) of every row; a null text counts as empty. No shuffle."""
    wanted = docs.select("doc_id", docs[text].alias("text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(t or "", length, scale).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "sketch"])

    return wanted.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, sketch array<long>")


def merged(parts: DataFrame, by: list[str], scale: int = SCALE) -> DataFrame:
    """One sketch for each group of sketches, as merge() makes it; pre-aggregated before the shuffle.

    Hashes below the threshold stay, else the group's least one; a group of empty
    sketches has an empty one. A group is gathered as its sketch alone, whose size
    is the group's shingles by the scale: it is the row that is returned.
    """
    h = F.col("h")
    low = F.when((h >= 0) & (h < (1 << 64) // scale), h)  # hashes are unsigned
    found = parts.select(*by, F.explode_outer("sketch").alias("h")).distinct().groupBy(*by)
    found = found.agg(F.sort_array(F.collect_list(low)).alias("low"), F.min(F.when(h.isNotNull(), F.struct(h < 0, h.alias("h")))).alias("least"))
    empty = F.array().cast("array<bigint>")
    return found.select(*by, F.when(F.size("low") > 0, F.col("low")).when(F.col("least").isNotNull(), F.array("least.h")).otherwise(empty).alias("sketch"))


def _ranges(docs: DataFrame) -> int:
    """Ranges of ids: several for each shuffle partition, and so many that each has about RANGE_BYTES of text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_RANGES, max(RANGES * shuffle_partitions(docs.sparkSession), -(-size // RANGE_BYTES)))


def ranged(docs: DataFrame) -> DataFrame:
    """bucket, guest, doc_id and text: documents in ranges of ids, each range with the next one's first as its guest.

    The ranges are cut at rows of a sample, which is bounded by the number of
    ranges: at their id, as it is, whatever its type, and then at the beginning of
    their text, so rows without an id, or of one id, are dealt over ranges too.
    The heads of the ranges are a row a range, and so are the guests. Texts are
    shuffled once. After the last range comes the first.
    """
    spark = docs.sparkSession
    n = _ranges(docs)
    kind = docs.schema["doc_id"].dataType
    key = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", F.substring("text", 1, HEAD).alias("head"))
    drawn = docs.select(key.alias("key"), F.xxhash64("doc_id", "text", F.lit(3)).alias("hash")).orderBy("hash", "key").limit(DRAWS * n)
    drawn = [r.key for r in drawn.orderBy("key").collect()]
    cuts = list(dict.fromkeys(drawn[i * len(drawn) // n] for i in range(1, n))) if drawn else []
    form = T.StructType().add("has", T.BooleanType()).add("doc_id", kind).add("head", T.StringType())
    step = max(1, round(len(cuts) ** 0.5))

    def literal(values: list) -> Column:
        made = [F.struct(F.lit(v.has).alias("has"), F.lit(v.doc_id).cast(kind).alias("doc_id"), F.lit(v["head"]).alias("head")) for v in values]
        return F.array(*made).cast(T.ArrayType(form)) if made else F.array().cast(T.ArrayType(form))

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda c: c <= F.col("key")))

    # the number of cuts up to a row: whole steps first, then within one step
    steps = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    whole = below(literal([s[-1] for s in steps]))
    inside = F.element_at(F.array(*map(literal, steps), literal([])), whole + 1)
    bucket = (whole * step + below(inside)).cast("int").alias("bucket")

    rows = docs.select(key.alias("key"), "doc_id", "text").select(bucket, "key", "doc_id", "text")
    heads = sorted(rows.groupBy("bucket").agg(F.min("key").alias("first")).collect(), key=lambda r: r.bucket)
    table = [(r.bucket, r["first"], heads[i - 1].bucket) for i, r in enumerate(heads)]
    first = F.broadcast(spark.createDataFrame(table, T.StructType().add("bucket", T.IntegerType()).add("first", form).add("before", T.IntegerType())))
    # rows that share the head's id and beginning are few but for copies; one of them, with the least text, is the guest
    same = rows.join(first, "bucket").filter(F.col("key").eqNullSafe(F.col("first")))
    guests = same.groupBy(F.col("before").alias("bucket")).agg(F.any_value("doc_id").alias("doc_id"), F.min("text").alias("text")).withColumn("guest", F.lit(1))
    placed = rows.select("bucket", "doc_id", "text", F.lit(0).alias("guest")).unionByName(guests)
    parts = max(shuffle_partitions(spark), n // RANGES)
    return placed.select("bucket", "guest", "doc_id", "text").repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", "doc_id", "text")


def fingerprints(docs: DataFrame, length: int = LENGTH, scale: int = SCALE, sketches: bool = False) -> DataFrame:
    """Every row's fingerprint beside that of its edited text, and their likeness.

    The edited text has the last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document's, in ascending order of doc_id.
    Null ids come first; rows with one id are ordered by text; after the last row
    comes the first, and a single row is its own next. A null text counts as
    empty: its sketch is empty, and like another empty one by 1. Extra columns
    are left out; an empty table gives no rows. Whole texts are shuffled once.
    """
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "kept_in_edited", "n_hashes"]
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_in_edited double, n_hashes long"
    if sketches:
        schema += ", sketch array<long>, edited_sketch array<long>"
        names += ["sketch", "edited_sketch"]

    def row(key, text: str, own: np.ndarray, after: str, next_own: np.ndarray) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        other = sketch(edited, length, scale)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out = (key, len(text), sha, digest(own), digest(other), likeness(own, other), likeness(own, next_own), containment(own, other), len(own))
        return out + ((own.view(np.int64), other.view(np.int64)) if sketches else ())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        held = None  # the row that waits for its next: bucket, id, text, sketch
        for batch in batches:
            if types is None:
                types = [batch.schema.field("doc_id").type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 3, pa.int64(), *[pa.list_(pa.int64())] * (2 * sketches)]
            out = []
            for bucket, guest, key, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text")), strict=True):
                own = sketch(text, length, scale)
                if held and held[0] == bucket:
                    out.append(row(*held[1:], text, own))
                held = None if guest else (bucket, key, text, own)
            columns = list(zip(*out, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return ranged(texts).mapInArrow(run, schema)
