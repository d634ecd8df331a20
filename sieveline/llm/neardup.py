"""Near-duplicate components with SetSketch registers.

A document's set of word shingles becomes ``REGISTERS`` exponentially spaced,
truncated minima: register i keeps floor(1 - log_b(least exponential hash)), so
two sketches merge by their maxima and two registers agree about as often as the
sets are alike. Documents with one and the same sequence of words form a class
first, by aggregation over a digest of the words, so that groups of exact copies
cost one sketch.

Candidates come from bands of ``WIDTH`` registers. In a round every class meets
one class alone: of the representatives of its buckets, that of most of them. A
round has an order of its own in which the first member of a bucket represents,
so its pairs are as many as the classes at most, and texts travel once a member
and once a part of a representative's members. Buckets whose members are then in one component are
done. After the first, rounds go on while a bucket is larger than a block and
they close half of what is open. In the buckets that are left, and only there, members of different
components are compared with each other, in blocks of bounded rows and bytes, so
no link is lost to the choice of representatives. A pair is named by the first
band that it shares alone.

A pair's likeness is estimated by maximum likelihood from the counts of larger,
smaller and equal registers and the two set sizes together; a pair well below the
threshold goes no further. The rest are confirmed on the full sets of real words,
numbered without hashes. At the threshold, a pair shares no band with probability (1 - 0.8 ** 5) ** 48 < 1e-8,
and the margin of the estimate is more than four standard errors.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Tables, shared_checkpoint
from .components import components
from .skew import joined
from .text import U64, Block, blocks, exact_sets, mix, shingles, tidy, word_digests

REGISTERS = 320
#: Ratio of neighbouring values: registers of sets of up to a thousand million shingles fit in a byte.
SPACING = 1.1
#: Rounds of representatives at most; what they leave open is compared in blocks.
ROUNDS = 16
RATE = 20.0
BANDS, WIDTH = 48, 5
SHINGLE = 4
#: A link has MANY * shared >= OF * (all shingles of both).
MANY, OF = 100, 80
MARGIN = 0.1
#: Members of a bucket, and bytes of their texts, in each of the two blocks that are compared at once, on average; a longer text is a block's worth.
ROWS = 1024
BYTES = 8 << 20
#: Bytes of members that are compared with their representative at once, at least.
PIECE = 1 << 20

_rng = np.random.default_rng(4)
_FACTORS = (_rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint64) * U64(2) + U64(1)).astype(np.uint32)
_TERMS = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The SetSketch registers of a set of distinct 64-bit hashes."""
    top = np.zeros(REGISTERS, np.uint32)
    low = (hashes ^ (hashes >> U64(32))).astype(np.uint32)
    for i in range(0, len(low), 256):
        x = low[i : i + 256, None] * _FACTORS + _TERMS
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        np.maximum(top, x.max(axis=0), out=top)
    # the least of -ln(u) / RATE is at the largest u
    least = -np.log((top.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(SPACING)), 0, 255).astype(np.uint8)


def band_keys(table: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each row of registers."""
    part = table[:, : BANDS * WIDTH].astype(np.uint64).reshape(len(table), BANDS, WIDTH)
    key = np.zeros((len(table), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for i in range(WIDTH):
        key = mix(key * U64(0x9E3779B97F4A7C15) + part[:, :, i])
    return key.view(np.int64)


def likeness(more: np.ndarray, less: np.ndarray, same: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of greatest likelihood from register counts and set sizes."""
    u, v = a / (a + b), b / (a + b)

    def p(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-np.clip(x, 0, 1) * (SPACING - 1) / SPACING) / np.log(SPACING), 1e-12)

    def value(j: np.ndarray) -> np.ndarray:
        x, y = p(u - v * j), p(v - u * j)
        return more * np.log(x) + less * np.log(y) + same * np.log(np.maximum(1 - x - y, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(48):
        third = (high - low) / 3
        left, right = low + third, high - third
        up = value(left) < value(right)
        low, high = np.where(up, left, low), np.where(up, high, right)
    return (low + high) / 2


def close(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Which rows of two register tables may be linked, by sizes and the estimate."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    out = MANY * small >= OF * large
    same = agreeing(a, b)
    out &= same >= (OF / MANY - 2 * MARGIN) * REGISTERS
    at = np.flatnonzero(out)
    if len(at):
        x, y = a[at], b[at]
        more, less = (x > y).sum(1), (x < y).sum(1)
        out[at] = likeness(more, less, same[at], na[at].astype(float), nb[at].astype(float)) >= OF / MANY - MARGIN
    return out


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers in which each row of a agrees with b's row, or with the one row of b."""
    x = a.view(np.uint64) ^ b.view(np.uint64)
    for shift in (4, 2, 1):
        x |= x >> U64(shift)
    return a.shape[-1] - np.bitwise_count(x & U64(0x0101010101010101)).sum(-1, dtype=np.int64)


def first_band(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band in which rows agree; BANDS without one."""
    alike = (a == b)[:, : BANDS * WIDTH].reshape(-1, BANDS, WIDTH).all(2)
    return np.where(alike.any(1), alike.argmax(1), BANDS)


def sketches(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, n_bytes, class (digest of the words in their order) and sketch (registers) of every row."""
    return sketched(docs, k, registers)


def sketched(docs: DataFrame, k: int, make: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """doc_id, n_shingles, n_bytes, class and sketch of every row, as ``make`` makes it of a set of hashes."""
    kind = dict(docs.dtypes)["doc_id"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                hashes, at = shingles(block, k)
                sets = [np.unique(hashes[at[i] : at[i + 1]]) for i in range(len(block))]
                columns = [
                    batch.column("doc_id")[block.first : block.first + len(block)],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.diff(block.offsets), pa.int64()),
                    pa.array(word_digests(block), pa.binary()),
                    pa.array([make(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "n_bytes", "class", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, n_bytes long, class binary, sketch binary")


def _table(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, REGISTERS)


def close_to(members: list[bytes], n: np.ndarray, head: bytes, head_n: int) -> np.ndarray:
    table = _table(members)
    return close(table, np.repeat(_table([head]), len(table), 0), n, np.full(len(n), head_n))


def banded(classes: DataFrame) -> DataFrame:
    """key, band and node of every band of every class."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(_table(batch.column("sketch").to_pylist()))
            nodes = np.repeat(batch.column("node").to_numpy(), BANDS)
            bands = np.tile(np.arange(BANDS, dtype=np.int8), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(bands), pa.array(nodes)], ["key", "band", "node"])

    return classes.select("node", "sketch").mapInArrow(run, "key long, band byte, node long")


def linked(x: np.ndarray, y: np.ndarray, of: int = OF) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return MANY * shared >= of * (len(x) + len(y) - shared)


def together(*columns: pa.Array) -> Block:
    """All texts of some columns, one column after the other, as one block."""
    return next(blocks(pa.chunked_array([c.cast(pa.large_string()) for c in columns], pa.large_string()), 1 << 62))


class Method(NamedTuple):
    """How classes meet and are compared: what near_components leaves to an operator.

    ``keys`` gives key, band and node of every bucket of every class; ``close``
    says which members (sketches, set sizes) may be linked with one more class;
    ``partners`` compares the members of an open bucket. Links are sets of
    ``k``-word shingles with MANY * shared >= ``of`` * (all of both).
    """

    k: int
    of: int
    keys: Callable[[DataFrame], DataFrame]
    close: Callable[[list[bytes], np.ndarray, bytes, int], np.ndarray]
    partners: Callable[[list[tuple]], list[tuple]]


def chosen(left: DataFrame, turn: int, total: int) -> DataFrame:
    """node and head: for each class the representative of most of its open buckets, one of another component.

    A bucket is represented by its first member in an order of the round's own,
    the same in all buckets, so near copies mostly have one and the same head.
    """
    first = F.xxhash64("node", F.lit(turn))
    heads = left.groupBy("key").agg(F.min_by(F.struct("node", "comp"), first).alias("other"), F.any_value("n").alias("n"))
    met = joined(left, heads, "key", "node", total, counted=True).filter("comp <> other.comp").select("node", F.col("other.node").alias("head"))
    times = met.repartition("node").groupBy("node", "head").agg(F.count("*").alias("times"))
    return times.groupBy("node").agg(F.max_by("head", F.struct("times", "head")).alias("head"))


def led(pairs: DataFrame, values: DataFrame, columns: list[str], work: Callable, total: int) -> DataFrame:
    """The pairs (node, head) that ``work`` keeps, which gets a head's row and its members' rows, some at a time.

    Members of a head are dealt into parts of about ROWS, each of which gets the
    head's row once, and every member travels once. A task reads a part as a
    stream, and hands it on in pieces of bounded bytes.
    """
    counts = pairs.groupBy("head").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / ROWS).cast("int")
    members = joined(pairs, counts, "head", "node", total).select("node", "head", F.pmod(F.xxhash64("node", F.lit(5)), parts).alias("part"), F.lit(1).alias("member"))
    heads = counts.select(F.col("head").alias("node"), "head", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("member"))
    rows = members.unionByName(heads).join(values, "node").select("head", "part", "member", "node", *columns)
    rows = rows.repartition("head", "part").sortWithinPartitions("head", "part", "member")
    names = ["head", "part", "member", "node", *columns]

    def kept(head: tuple, group: list[tuple]) -> pa.RecordBatch:
        mask = work(head[4:], [row[4:] for row in group]) if group else []
        keep = [row[3] for row, yes in zip(group, mask, strict=True) if yes]
        return pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array([head[3]] * len(keep), pa.int64())], ["node", "head"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, group, size = None, [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if not row[2]:
                    if group:
                        yield kept(head, group)
                    head, group, size = row, [], 0
                    continue
                if head is None or row[:2] != head[:2]:
                    raise RuntimeError(f"members of {row[0]} without their representative")
                group.append(row)
                size += len(row[-1])
                if size >= PIECE:
                    yield kept(head, group)
                    group, size = [], 0
        if group:
            yield kept(head, group)

    return rows.mapInArrow(run, "node long, head long")


def estimated(pairs: DataFrame, classes: DataFrame, method: Method, total: int) -> DataFrame:
    """The pairs (node, head) that the comparison of sketches leaves."""
    close_to = method.close

    def work(head: tuple, members: list[tuple]) -> np.ndarray:
        return close_to([m[1] for m in members], np.array([m[0] for m in members], np.int64), head[1], head[0])

    return led(pairs, classes.select("node", "n_shingles", "sketch"), ["n_shingles", "sketch"], work, total)


def confirmed(pairs: DataFrame, texts: DataFrame, method: Method, total: int) -> DataFrame:
    """The pairs (node, head) whose full sets of words are alike enough."""
    k, of = method.k, method.of

    def work(head: tuple, members: list[tuple]) -> list[bool]:
        sets = exact_sets(together(pa.array([head[0], *(m[0] for m in members)], pa.large_string())), k)
        return [linked(sets[0], s, of) for s in sets[1:]]

    return led(pairs, texts, ["text"], work, total)


def matched_texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text: one text with the words of each of the classes named."""
    wanted = classes.join(nodes, "node", "left_semi").select("node", "class", F.col("least").alias("doc_id"))
    found = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(wanted, "doc_id").select("node", "class", "text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # rows that repeat an id may have other texts
            own = [digest for block in blocks(batch.column("text")) for digest in word_digests(block)]
            mask = pa.array([a == b for a, b in zip(own, batch.column("class").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(mask), batch.column("text").filter(mask)], ["node", "text"])

    return found.mapInArrow(run, "node long, text string").dropDuplicates(["node"])


def crossed(open_members: DataFrame, classes: DataFrame, texts: DataFrame, total: int, method: Method) -> DataFrame:
    """Links (a, b) between members of one bucket in different components, confirmed on the full sets.

    Members are dealt in blocks by a hash, as many as their rows and bytes ask
    for, and each two blocks of a bucket are compared in a group of their own, so
    a large bucket is neither held nor compared in one place. Pairs stay inside
    their group: what leaves the comparison is a row for each member that the
    estimate leaves a partner, and what leaves the confirmation are links that
    join what the group had not yet joined. A pair that shares several buckets is
    compared in the first alone.
    """
    sized = open_members.join(classes.select("node", "n_bytes"), "node")
    parts = F.greatest(F.ceil(F.count("*") / ROWS), F.ceil(F.sum("n_bytes") / BYTES)).cast("int")
    buckets = sized.groupBy("key").agg(F.any_value("n").alias("n"), parts.alias("parts"))
    blocked = joined(sized, buckets, "key", "node", total, counted=True).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    dealt = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "band", "block", "node", "comp")
    rows = dealt.join(classes.select("node", "n_shingles", "sketch"), "node")
    found = _grouped(rows, ["key", "i", "j", "band", "block", "node", "comp", "n_shingles", "sketch"], method.partners, "key long, i int, j int, node long, partners array<long>")
    return _grouped(found.join(texts, "node"), ["key", "i", "j", "node", "partners", "text"], _confirmer(method.k, method.of), "a long, b long").distinct()


def _grouped(rows: DataFrame, columns: list[str], work, schema: str) -> DataFrame:  # noqa: ANN001
    """What ``work`` makes of the rows of each (key, i, j), which one task reads in order."""
    rows = rows.select(*columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    fields = [part.split() for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}

    def made(out: list[tuple]) -> pa.RecordBatch:
        values = list(zip(*out, strict=True)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(v, kinds[kind]) for v, (_, kind) in zip(values, fields, strict=True)], [name for name, _ in fields])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if group and group[0][:3] != row[:3]:
                    out += work(group)
                    group = []
                group.append(row)
            yield made(out)
        if group:
            yield made(work(group))

    return rows.mapInArrow(run, schema)


def _partners(group: list[tuple]) -> list[tuple]:
    """key, i, j, node and partners of every member of a group that has or is a partner."""
    key, i, j, band = group[0][:4]
    block, node, comp, n = (np.array([r[c] for r in group]) for c in (4, 5, 6, 7))
    table = _table([r[8] for r in group])
    least = (OF / MANY - 2 * MARGIN) * REGISTERS
    left, right = [], []
    for x in np.flatnonzero(block == i):
        at = (node > node[x]) if i == j else (block == j)
        at = np.flatnonzero(at & (comp != comp[x]) & (MANY * n >= OF * n[x]) & (MANY * n[x] >= OF * n))
        if len(at):
            at = at[agreeing(table[at], table[x]) >= least]
            left.append(np.full(len(at), x))
            right.append(at)
    partners: dict[int, list[int]] = {}
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        for at in np.array_split(np.arange(len(a)), len(a) // 20_000 + 1):
            x, y = a[at], b[at]
            keep = first_band(table[x], table[y]) == band
            x, y = x[keep], y[keep]
            keep = close(table[x], table[y], n[x], n[y]) if len(x) else np.zeros(0, bool)
            for p, q in zip(node[x[keep]].tolist(), node[y[keep]].tolist(), strict=True):
                partners.setdefault(p, []).append(q)
                partners.setdefault(q, [])
    return [(key, i, j, p, q) for p, q in partners.items()]


def _confirmer(k: int, of: int):  # noqa: ANN202
    def confirm(group: list[tuple]) -> list[tuple]:
        """Links of a group on full sets, without those between members that it has joined already."""
        sets = dict(zip((r[3] for r in group), exact_sets(together(pa.array([r[5] for r in group])), k), strict=True))
        parent = {p: p for p in sets}

        def root(p: int) -> int:
            while parent[p] != p:
                parent[p] = parent[parent[p]]
                p = parent[p]
            return p

        out = []
        for r in group:
            for q in r[4]:
                x, y = root(r[3]), root(q)
                if x != y and linked(sets[r[3]], sets[q], of):
                    parent[x] = y
                    out.append((min(r[3], q), max(r[3], q)))
        return out

    return confirm


def still_open(members: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """key, band, node, n and comp of the buckets whose members are in several components."""
    own = members.join(found, "node", "left").select("key", "band", "node", "n", F.coalesce("component", "node").alias("comp"))
    mixed = own.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.any_value("n").alias("n")).filter("least < most")
    return joined(own, mixed.select("key", "n"), "key", "node", total, counted=True)


def near_components(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    A null or empty text, or one of white space alone, has no shingles and is
    linked with nothing. A row without doc_id is linked with nothing, has a null
    component_id and is kept. Rows that repeat a doc_id are documents of their
    own; those that share a component share its least id, and every row with that
    id is kept. Extra columns are left out; an empty table gives no rows.
    """
    return linked_components(docs, sketches(docs, k), Method(k, OF, banded, close_to, _partners))


def linked_components(docs: DataFrame, sketched_rows: DataFrame, method: Method) -> DataFrame:
    """near_components by any method; every table of its own but the result's is dropped."""
    tables = Tables(docs.sparkSession)
    rows = tables.keep("rows", sketched_rows)
    linkable = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    one = (F.any_value(c).alias(c) for c in ("n_shingles", "n_bytes", "sketch"))
    classes = linkable.groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"), *one)
    classes = tables.keep("classes", classes.withColumn("node", F.monotonically_increasing_id()))

    keys = method.keys(classes)
    total = sum(keys.agg(F.count("*")).first())
    heads = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = tables.keep("members", joined(keys, heads, "key", "node", total))
    texts = tables.keep("texts", matched_texts(docs, classes, members.select("node").distinct()))
    _let_go(docs)

    links, left, turn = None, members.withColumn("comp", F.col("node")), 0
    before = n = largest = members.count()
    while n and turn < ROUNDS and (not turn or (largest > ROWS and n <= before / 2)):
        pairs = tables.keep(f"pairs{turn}", chosen(left, turn, total))
        near = tables.keep(f"near{turn}", estimated(pairs, classes, method, pairs.count()))
        new = confirmed(near, texts, method, near.count()).select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b"))
        links, found = _joined(links, new)
        left = tables.keep(f"open{turn}", still_open(members, found, total))
        for name in (f"pairs{turn}", f"near{turn}", *([f"open{turn - 1}"] if turn else [])):
            tables.drop(name)
        _let_go(docs)
        before, turn = n, turn + 1
        n, largest = left.agg(F.count("*"), F.max("n")).first()
    if n:
        links, found = _joined(links, crossed(left, classes, texts, total, method))
    elif not turn:
        found = docs.sparkSession.createDataFrame([], "node long, component long")
    for name in ("members", "texts", *([f"open{turn - 1}"] if turn else [])):
        tables.drop(name)
    _let_go(docs)

    own = classes.select("class", "node", "least", "rows").join(found, "node", "left")
    own = own.select("class", "node", "least", "rows", F.coalesce("component", "node").alias("comp"))
    least = own.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = joined(own.drop("least"), least, "comp", "node", classes.count()).select("class", "component_id", F.col("rows").alias("n"))
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("class")).alias("class"))
    in_class = joined(out.filter("class IS NOT NULL"), named, "class", "doc_id", rows.count()).select("doc_id", "n_shingles", "component_id")
    alone = out.filter("class IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    result = tables.keep("result", in_class.unionByName(alone).withColumn("kept", kept))
    tables.drop("rows")
    tables.drop("classes")
    return result


def _let_go(df: DataFrame) -> None:
    """Have the driver collect what is unreachable, on which Spark drops the shuffle files behind checkpoints.

    Spark has no call that drops a query's shuffle files by name: they go when
    the last reference to them in the driver does, which without this is half an
    hour later.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def _joined(links: DataFrame | None, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links as stars of their components, and the components."""
    found = shared_checkpoint(components(new if links is None else links.unionByName(new)))
    return found.select(F.col("node").alias("a"), F.col("component").alias("b")), found


def sql(of: int = OF, kept: bool = True) -> str:
    """DuckDB SQL of the query, over all pairs that share a shingle."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {MANY} * k >= {of} * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON a = c)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id{', m.c = d.doc_id AS kept' if kept else ''}
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) m ON m.doc_id = d.doc_id"""
