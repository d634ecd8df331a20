"""Byte-level BPE by merge replay over a corpus of words.

Texts are split by the tokenizer's pattern, and the distinct words of a block of
documents form one corpus: their tokens lie in one linked list, and an inverted
index holds, for each pair of neighbouring tokens, the positions at which it
stands. Merges are applied in rank order. One merge visits the positions of its
pair alone and updates only the neighbours that it touches, which may add pairs
of any later or earlier rank to the queue; a queue by rank gives each word the
same result as merging its own lowest pair again and again, as merges in one
word never depend on another's. The split of each word is then replayed into
all its occurrences. No shuffle is needed: a task's words are its own corpus,
and what it has replayed stays in a bounded store for its later blocks.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .text import blocks, tidy

#: Bytes of a block, whose distinct words are replayed together.
SIZE = 1 << 20
#: Words kept, with their ids, between a worker's blocks.
KEPT = 300_000
#: Longer words are replayed but not kept.
KEPT_LENGTH = 40


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The token made of a pair, for every pair of tokens whose bytes together are a token."""
    table = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                table[left, right] = rank
    return table


_first: dict[int, tuple] = {}


def first_merges(ranks: dict[bytes, int], table: dict[tuple[int, int], int]) -> tuple[list[int], list[int]]:
    """The token of each byte, and the token made of each two bytes or -1; kept for the last vocabulary."""
    if id(table) not in _first:
        single = [ranks.get(bytes([b]), -1) for b in range(256)]
        pairs = [table.get((a, b), -1) for a in single for b in single]
        _first.clear()
        _first[id(table)] = single, pairs, table
    return _first[id(table)][:2]


def replay(words: Iterable[bytes], ranks: dict[bytes, int], table: dict[tuple[int, int], int]) -> list[tuple[int, ...]]:
    """The token ids of each word."""
    single, pairs = first_merges(ranks, table)
    token: list[int] = []
    starts: list[int] = []
    index: dict[int, list[int]] = defaultdict(list)
    for word in words:
        at = len(token)
        starts.append(at)
        whole = ranks.get(word)
        if whole is None:
            token += map(single.__getitem__, word)
            for i, (a, b) in enumerate(zip(word, word[1:], strict=False), at):
                if (made := pairs[a << 8 | b]) >= 0:
                    index[made].append(i)
        else:
            token.append(whole)
        token.append(-1)  # words end in a token that pairs with none
    n = len(token)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    get = table.get
    queue = list(index)
    heapq.heapify(queue)
    # a queue entry is the made token, whose rank is its id; all pairs that make it merge at this rank, from the left
    while queue:
        made = heapq.heappop(queue)
        places = index.pop(made, None)
        if not places:
            continue
        places.sort()
        for i in places:
            left = token[i]
            if left < 0:
                continue
            j = after[i]
            if j >= n or get((left, token[j])) != made:
                continue  # a neighbour's merge has taken it
            token[i] = made
            token[j] = -2
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                new = get((made, token[k]))
                if new is not None:
                    if new not in index:
                        heapq.heappush(queue, new)
                    index[new].append(i)
            h = before[i]
            if h >= 0:
                new = get((token[h], made))
                if new is not None:
                    if new not in index:
                        heapq.heappush(queue, new)
                    index[new].append(h)
    ids = []
    for i in starts:
        one = []
        while token[i] != -1:
            one.append(token[i])
            i = after[i]
        ids.append(tuple(one))
    return ids


class Encoder:
    """Encodes blocks of texts; keeps the splits of words it has met, up to ``KEPT``."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        self.table = merge_table(self.ranks)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        parts = [self.split(text) for text in texts]
        corpus = set().union(*parts)
        known = self.known
        new = [word for word in corpus if word not in known]
        fresh = dict(zip(new, replay([word.encode() for word in new], self.ranks, self.table), strict=True))
        out = []
        for part in parts:
            ids: list[int] = []
            for word in part:
                ids += known[word] if word in known else fresh[word]
            out.append(ids)
        room = max(0, KEPT - len(known))
        known.update(islice(((word, ids) for word, ids in fresh.items() if len(word) <= KEPT_LENGTH), room))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for a Python worker."""
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, ids: bool = True, text: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, with ids if asked, and the decoded text too.

    A null text counts as empty: it has no ids. Any text is one sequence of
    UTF-8, encoded whole. Repeated rows and ids give repeated results; extra
    columns are left out; an empty table gives no rows. ``path`` must be there
    on every executor.
    """
    wanted = docs.select("doc_id", docs[text].alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * ids + ", decoded string" * decoded

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        collecting = gc.isenabled()
        gc.disable()  # what is kept has no cycles; searching it for them costs more than the replay
        try:
            yield from encoded(coder, batches)
        finally:  # the worker goes on to other tasks
            if collecting:
                gc.enable()

    def encoded(coder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), SIZE):
                texts = [block.bytes_of(i).decode() for i in range(len(block))]
                found = coder.encode(texts)
                back = [coder.decode(x) for x in found]
                columns = [
                    batch.column("doc_id").slice(block.first, len(block)),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in found], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                ]
                columns += [pa.array(found, pa.list_(pa.int32()))] * ids
                columns += [pa.array([x.decode() for x in back], pa.string())] * decoded
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids + ["decoded"] * decoded
                yield pa.RecordBatch.from_arrays(columns, names)

    return wanted.mapInArrow(run, schema)
