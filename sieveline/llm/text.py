"""Vectorised words and shingles over blocks of UTF-8 text.

A block is a run of whole documents: their bytes in one array and the offsets
between them. Blocks hold about ``BLOCK`` bytes, or one longer document, which
bounds what a task holds at once.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
#: Bytes 9 to 13 and 32 part words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U64 = np.uint64
ODD = U64(0x9E3779B97F4A7C15)
#: Longer spans are hashed one by one.
LONG = 64
#: What is left of eight bytes when only the first n count.
FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def give_back() -> None:
    """Return freed memory to the system, as far as Arrow and the GNU library keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A batch function that gives freed memory back to the system when its task ends.

    Python workers live on between tasks; without this each keeps the most that
    any task of its life has used.
    """

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


class Block(NamedTuple):
    """Documents first..first+n of a batch: their bytes and n + 1 offsets."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK) -> Iterator[Block]:
    """The blocks of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield Block(at, raw[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words(NamedTuple):
    """Spans of words, the document of each, and the words before each document."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    before: np.ndarray


def spans(block: Block, kind: np.ndarray) -> Words:
    """Longest runs of bytes of one kind (kind 0 parts them), never across documents."""
    n = len(block.data)
    edge = np.ones(n + 1, bool)
    if n:
        edge[1:n] = kind[1:] != kind[:-1]
        edge[block.offsets] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    if n:
        full = kind[start] != 0
        start, end = start[full], end[full]
    else:
        start = end = np.zeros(0, np.int64)
    before = np.searchsorted(start, block.offsets)
    doc = np.repeat(np.arange(len(block)), np.diff(before))
    return Words(start, end, doc, before)


def words(block: Block) -> Words:
    return spans(block, (~SPACE[block.data]).astype(np.uint8))


def spelled(data: np.ndarray, keep: np.ndarray, w: Words) -> pa.DictionaryArray:
    """The words of spans that hold all bytes to keep and no others, numbered by their bytes."""
    at = np.concatenate([[0], np.cumsum(keep)])
    ends = np.concatenate([at[w.start], at[w.end[-1:]]]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(ends), pa.py_buffer(data[keep])]).dictionary_encode()


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, alike for equal bytes anywhere.

    Eight bytes at a time go through the finaliser, which has no sums or
    products to cancel: spans of one length up to eight never share a hash.
    """
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    h = mix(size.astype(np.uint64) + ODD)
    live = np.flatnonzero(size <= LONG)
    for at in range(0, LONG, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        h[live] = mix((h[live] ^ (eight[start[live] + at] & FIRST[np.minimum(size[live] - at, 8)])) * ODD)
    for i in np.flatnonzero(size > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_digests(block: Block) -> list[bytes]:
    """128-bit digests of each document's A-Z lower-cased words, in their order."""
    space = SPACE[block.data]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]  # one blank after each word
    first = block.offsets[:-1][np.diff(block.offsets) > 0]
    keep[first] = ~space[first]
    packed = np.where(space, np.uint8(32), LOWER[block.data])[keep]
    at = np.concatenate([[0], np.cumsum(keep)])[block.offsets]
    return [hashlib.blake2b(packed[a:b].tobytes().rstrip(b" "), digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]


def exact_sets(block: Block, k: int) -> list[np.ndarray]:
    """Each document's distinct k-word shingles as whole numbers that are equal for equal words alone, within this block.

    Words are numbered by their bytes, without hashes. A document with fewer
    words is one shingle, filled up with a number that no word has.
    """
    w = words(block)
    number = spelled(LOWER[block.data], ~SPACE[block.data], w).indices.to_numpy().astype(np.uint64) + U64(1)
    count = np.diff(w.before)
    room = np.where(count > 0, np.maximum(count, k), 0)
    first = np.concatenate([[0], np.cumsum(room)])
    code = np.zeros(first[-1], np.uint64)
    code[np.arange(len(number)) + np.repeat(first[:-1] - w.before[:-1], count)] = number
    each, most = code, int(number.max(initial=0)) + 1
    values = most
    for i in range(1, k):
        if values * most >= 1 << 63:
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
            values = int(code.max(initial=U64(0))) + 1
        code = code[:-1] * U64(most) + each[i:]
        values *= most
    return [np.unique(code[a : max(a, b - k + 1)]) for a, b in zip(first[:-1], first[1:], strict=True)]


def shingles(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k-word shingle of A-Z lower-cased words, and offsets by document.

    A document with fewer words, but some, has its whole sequence as its one
    shingle; without words it has none. Repeats are kept.
    """
    data = LOWER[block.data]
    w = words(block)
    h = span_hashes(data, w.start, w.end)
    count = np.diff(w.before)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    if len(h) >= k:
        total = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            total = total * ODD + h[i : len(h) - k + 1 + i]
        inside = w.doc[: len(total)] == w.doc[k - 1 :]
        long = mix(total[inside] + U64(k))
    else:
        long = np.zeros(0, np.uint64)
    result = np.zeros(out[-1], np.uint64)
    short = (count > 0) & (count < k)
    is_short = np.repeat(short, n)
    result[~is_short] = long
    for i in np.flatnonzero(short):
        total = U64(0)
        with np.errstate(over="ignore"):
            for x in h[w.before[i] : w.before[i + 1]]:
                total = total * ODD + x
            result[out[i]] = mix(np.array([total + U64(count[i])], np.uint64))[0]
    return result, out
