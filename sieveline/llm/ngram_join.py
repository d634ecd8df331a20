"""Jaccard join of documents on word shingles, by trees over count vectors.

Shingle hashes are parted into groups, and a document is the point of its counts
by group. What two documents share is at most the sum over groups of the smaller
count, so documents that are linked lie close: with sizes a and b, the counts
differ by at most ``(a + b) * (100 - OF) / (100 + OF)`` in all.

A tree over all coordinates at once can't part unlike documents, as each
coordinate alone differs by less than that. So the upper part of the tree lies
over subspaces: a level, for sizes alike, cuts the hash space into more blocks
than counts can differ, each of 65,536 groups, and points that are linked
coincide in one block at least. Such a region of coinciding points is a node of
the tree, and its place is its name, so points reach their nodes by an equality
join and no node's points need each other's level. A document lies in the levels
of all sizes that it may be linked with. An empty block says little, so its
region goes by the next block too, with at most one count between them: of blocks
that differ less than once on average, some block that agrees has such a
neighbour. Up to ``BLOCKS`` blocks all are used, which loses no link; of more,
as many, and a link is missed with probability below 1e-12.

Inside a node the points are packed, by size and the coordinates that vary most,
into leaves with their largest counts; pairs of leaves, then pairs of points, fall
to the bound by summed minima over ``GROUPS`` or more coordinates. Pairs
that survive are confirmed on the full sets of real words. A node with many
points, such as copies of one text, is first thinned by rounds with
representatives, and its rest is compared in blocks, as in ``neardup``, whose
steps these are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .neardup import MANY, Method, linked_components, sketched
from .neardup import sql as link_sql
from .text import U64, mix, tidy

SHINGLE = 4
#: A link has MANY * shared >= OF * (all shingles of both).
OF = 85
#: A level's largest size, times its least.
RATIO = 1.3
BLOCKS = 64
#: Coordinates of the bound: a power of two, at least so many, and at least one for EACH shingles.
GROUPS, EACH = 64, 8
#: Points of a leaf.
LEAF = 16
MOST = 65_535


@functools.cache
def levels(of: int) -> tuple[np.ndarray, np.ndarray]:
    """The least size of each level, and its number of blocks."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, int(low[-1] * RATIO)))
    top = np.array(low[1:], np.int64) - 1
    return np.array(low, np.int64), 2 * top * (MANY - of) // (MANY + of) + 1


def place_keys(hashes: np.ndarray, of: int) -> np.ndarray:
    """The names of all regions of a document, from its distinct hashes in order."""
    low, blocks = levels(of)
    n, out = len(hashes), []
    cells = mix((hashes & U64(MOST)) + U64(1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(cells)])
    first, last = np.searchsorted(low, [n, n * MANY // of], "right") - 1
    for level in range(first, last + 1):
        b = int(blocks[level])
        use, seen = min(b, BLOCKS), min(b, BLOCKS + 1)
        starts = np.searchsorted(hashes >> U64(32), (np.arange(seen + 1, dtype=np.uint64) << U64(32)) // U64(b))
        if seen == b:
            starts[-1] = n
        own = sums[starts[1:]] - sums[starts[:-1]]
        names = mix(mix(np.arange(use, dtype=np.uint64) + U64(1)) + U64(level))
        full = np.diff(starts)[:use] > 0
        out.append(mix(own[:use][full] ^ names[full]))
        for i in np.flatnonzero(~full):
            after = (i + 1) % b
            near = np.concatenate([own[after : after + 1], own[after] - cells[starts[after] : starts[after + 1]]])
            out.append(mix(np.unique(near) + mix(names[i : i + 1] + U64(7))))
    return np.unique(np.concatenate(out))


def point(hashes: np.ndarray, of: int) -> np.ndarray:
    """A document's counts and region names as bytes: the number of counts, the counts, the names."""
    groups = GROUPS
    while groups * EACH < len(hashes):
        groups *= 2
    counts = np.bincount(((hashes >> U64(16)) & U64(groups - 1)).astype(np.int64), minlength=groups)
    parts = [np.array([groups], "<u4"), np.minimum(counts, MOST).astype("<u2"), place_keys(hashes, of).astype("<u8")]
    return np.concatenate([p.view(np.uint8) for p in parts])


def counts_of(sketch: bytes) -> np.ndarray:
    return np.frombuffer(sketch, "<u2", int.from_bytes(sketch[:4], "little"), 4)


def keys_of(sketch: bytes) -> np.ndarray:
    return np.frombuffer(sketch, "<u8", offset=4 + 2 * int.from_bytes(sketch[:4], "little"))


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts.astype(np.int32).reshape(-1, groups).sum(0)


def placed(classes: DataFrame) -> DataFrame:
    """key, band (0) and node of every region of every class."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [keys_of(s) for s in batch.column("sketch").to_pylist()]
            nodes = np.repeat(batch.column("node").to_numpy(), [len(k) for k in keys])
            every = np.concatenate([*keys, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(np.zeros(len(every), np.int8)), pa.array(nodes, pa.int64())], ["key", "band", "node"])

    return classes.select("node", "sketch").mapInArrow(run, "key long, band byte, node long")


def reaches(shared: np.ndarray, a: np.ndarray, b: np.ndarray, of: int) -> np.ndarray:
    """Whether sets of these sizes, with so many shingles in common at most, may be linked."""
    return (MANY + of) * shared.astype(np.int64) >= of * (a + b)


def maybe(members: list[bytes], n: np.ndarray, head: bytes, head_n: int, of: int) -> np.ndarray:
    """Which members may be linked with one more document, by sizes and summed minima."""
    out = MANY * np.minimum(n, head_n) >= of * np.maximum(n, head_n)
    top = counts_of(head)
    for i in np.flatnonzero(out):
        own = counts_of(members[i])
        if max(own.max(), top.max()) < MOST:  # else counts may be cut, and bound nothing
            groups = min(len(own), len(top))
            shared = np.minimum(folded(own, groups), folded(top, groups)).sum()
            out[i] = reaches(shared, n[i], head_n, of)
    return out


def packed(points: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Leaves of about LEAF points: halves by size, then by the coordinate that varies most, and so on."""
    done, open_parts, turn = [], [(np.arange(len(n)), 0)], 0
    while open_parts:
        at, turn = open_parts.pop()
        if len(at) <= LEAF:
            done.append(at)
            continue
        by = n[at] if turn == 0 else points[at][:, points[at].var(0).argmax()]
        at = at[np.argsort(by, kind="stable")]
        open_parts += [(at[: len(at) // 2], turn + 1), (at[len(at) // 2 :], turn + 1)]
    return done


def tree_pairs(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, of: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of x with the rows of y that the bound leaves: leaf against leaf, then point against point."""
    right = packed(y, ny)
    hull, least = np.array([y[q].max(0) for q in right]), np.array([ny[q].min() for q in right])
    for p in packed(x, nx):
        box = np.minimum(hull, x[p].max(0)).sum(1)
        for q in np.flatnonzero(reaches(box, least, nx[p].min(), of)):
            at = right[q]
            shared = np.minimum(x[p][:, None, :], y[at][None, :, :]).sum(2)
            yes = reaches(shared, nx[p][:, None], ny[at][None, :], of)
            for i in np.flatnonzero(yes.any(1)):
                yield p[i], at[yes[i]]


def partners(group: list[tuple], of: int) -> list[tuple]:
    """key, i, j, node and partners of every member of a group that has or is a partner.

    A pair that shares several regions is named in that with the least name.
    """
    key, i, j = group[0][:3]
    block, node, comp, n = (np.array([r[c] for r in group]) for c in (4, 5, 6, 7))
    vectors = [counts_of(r[8]) for r in group]
    groups = min(len(v) for v in vectors)
    table = np.array([folded(v, groups) if v.max() < MOST else np.full(groups, MOST) for v in vectors])
    kinds, times = np.unique(comp, return_counts=True)
    most = comp == kinds[times.argmax()]  # those of the largest component are not compared with each other
    found: dict[int, list[int]] = {}
    names = {}
    sides = [(np.flatnonzero((block == i) & ~most), np.flatnonzero(block == j)), (np.flatnonzero((block == i) & most), np.flatnonzero((block == j) & ~most))]
    met = ((left[a], right[others]) for left, right in sides if len(left) and len(right) for a, others in tree_pairs(table[left], n[left], table[right], n[right], of))
    for x, y in met:
        for q in y[(comp[y] != comp[x]) & ((node[y] > node[x]) | (i != j))]:
            own, other = (names.setdefault(z, keys_of(group[z][8])) for z in (x, q))
            if np.intersect1d(own, other, assume_unique=True)[:1].view(np.int64) == key:
                found.setdefault(int(node[x]), []).append(int(node[q]))
                found.setdefault(int(node[q]), [])
    return [(key, i, j, p, q) for p, q in found.items()]


def join(docs: DataFrame, k: int = SHINGLE, of: int = OF) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    A null or empty text, or one of white space alone, has no shingles and is
    linked with nothing. A row without doc_id is linked with nothing and has a
    null component_id. Rows that repeat a doc_id are documents of their own;
    those that share a component share its least id. Extra columns are left out;
    an empty table gives no rows.
    """
    method = Method(k, of, placed, functools.partial(maybe, of=of), functools.partial(partners, of=of))
    return linked_components(docs, sketched(docs, k, functools.partial(point, of=of)), method).drop("kept")


def sql() -> str:
    """DuckDB SQL of the query, over all pairs that share a shingle."""
    return link_sql(OF, kept=False)
