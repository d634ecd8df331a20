"""Quality: random-indexing word vectors, a two-layer network and a temperature.

Every token (a run of letters, of digits or of other signs) falls in one of
``ROWS`` hashed rows, and every row has a sparse random index vector of a few
+1 and -1. A row's context vector is the sum of the index vectors of the tokens
that stand next to it anywhere in the corpus. It is summed over all documents:
tasks add up integers in one table of fixed size, and the tables are added part
by part, so reruns agree to the bit. A document is the mean of its tokens'
context vectors, scaled to length 1 and weighted down for frequent rows. A
two-layer network in numpy is trained on a bounded sample of labelled documents;
a fifth of that sample sets the temperature that calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import SUMS, fold, labelled, partial_sums, summed
from .text import U64, Block, blocks, give_back, mix, span_hashes, spans, tidy

ROWS = 1 << 14
WIDTH = 32
#: Entries of an index vector that are not 0.
MARKS = 4
MARKS_SEED = 0x5DEECE66D
#: Labelled rows that the network learns from, at most.
SAMPLE = 8000
THRESHOLD = 0.3
#: Zeros in the mean of a document's token vectors.
SHRINK = 8
PART = 256
#: Units of 1 in token vectors; 2 ** 16 tokens add up to less than 2 ** 31.
UNIT = 1 << 14
#: 0 space, 1 letters and bytes of longer code points, 2 digits, 3 other signs.
KIND = np.full(256, 3, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[48:58] = 2
KIND[65:91] = KIND[97:123] = KIND[128:] = 1


def marks() -> tuple[np.ndarray, np.ndarray]:
    """Place and sign of each row's marks."""
    h = mix(np.arange(ROWS * MARKS, dtype=np.uint64) + U64(MARKS_SEED)).reshape(ROWS, MARKS)
    return (h % U64(WIDTH)).astype(np.int64), ((h >> U64(40)) & U64(1)).astype(np.int64) * 2 - 1


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and document of each token, and the tokens before each document.

    A run of letters that stands one or two tokens before as well is an echo: it
    falls in row 0 whatever it says.
    """
    kind = KIND[block.data]
    w = spans(block, kind)
    hashes = span_hashes(block.data, w.start, w.end)
    rows = (hashes >> U64(64 - ROWS.bit_length() + 1)).astype(np.int64)
    letters = kind[w.start] == 1
    for back in (1, 2):
        rows[back:][(hashes[back:] == hashes[:-back]) & (w.doc[back:] == w.doc[:-back]) & letters[back:]] = 0
    return rows, w.doc, w.before


def contexts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Context vectors (ROWS x WIDTH integers) and counts of all rows, over all texts."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = marks()
        total = np.zeros(ROWS * (WIDTH + 1), np.int64)
        for batch in batches:
            for block in blocks(batch.column("text")):
                rows, doc, _ = tokens(block)
                near = doc[1:] == doc[:-1]
                a, b = rows[:-1][near], rows[1:][near]
                for own, other in ((a, b), (b, a)):
                    for m in range(MARKS):
                        at = own * (WIDTH + 1) + place[other, m]
                        total += np.bincount(at, sign[other, m], len(total)).astype(np.int64)
                total += np.bincount(rows * (WIDTH + 1) + WIDTH, minlength=len(total))
        table = total.reshape(-1, PART * (WIDTH + 1))
        full = [i for i in range(len(table)) if table[i].any()]
        yield partial_sums([(i, table[i]) for i in full])

    table = np.zeros((ROWS // PART, PART * (WIDTH + 1)), np.int64)
    for part, sums in summed(docs.select("text").mapInArrow(count, SUMS), ROWS // PART).items():
        table[part] = sums
    table = table.reshape(ROWS, WIDTH + 1)
    return table[:, :WIDTH], table[:, WIDTH]


def vectors(context: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What each token adds to its document: its context at length 1, less for frequent rows, in whole units.

    Sums of whole numbers don't depend on their order, so a text's score doesn't
    depend on its neighbours.
    """
    length = np.linalg.norm(context.astype(np.float64), axis=1, keepdims=True)
    share = counts[:, None] / max(1, counts.sum())
    return np.rint(context / np.maximum(length, 1e-9) * (0.01 / (0.01 + share)) * UNIT).astype(np.int32)


def pooled(block: Block, table: np.ndarray) -> np.ndarray:
    """Mean vector of each document's tokens and SHRINK zeros, so short texts stay near the prior."""
    rows, _, before = tokens(block)
    out = np.zeros((len(block), table.shape[1]))
    full = np.flatnonzero(np.diff(before))
    step = 1 << 16
    for i in range(0, len(full), 64):
        docs = full[i : i + 64]
        start, end = before[docs[0]], before[docs[-1] + 1]
        if end - start <= step:
            out[docs] = np.add.reduceat(table[rows[start:end]], before[docs] - start, axis=0)
        else:  # long documents by their counts
            for d in docs:
                out[d] = np.bincount(rows[before[d] : before[d + 1]], minlength=len(table)) @ table.astype(np.float64)
    return out / UNIT / (np.diff(before) + SHRINK)[:, None]


class Network(NamedTuple):
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


def logits(x: np.ndarray, net: Network) -> np.ndarray:
    # einsum adds up in one order for any number of rows, unlike a matrix product
    hidden = np.tanh(np.einsum("nd,dh->nh", (x - net.mean) / net.spread, net.w1) + net.b1)
    return np.einsum("nh,h->n", hidden, net.w2) + net.b2


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def probabilities(x: np.ndarray, net: Network) -> np.ndarray:
    return sigmoid(logits(x.astype(np.float64), net) / net.temperature)


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, on a grid."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, np.where(y > 0, -z, z) / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, steps: int = 600, decay: float = 1e-4, seed: int = 5) -> Network:
    """The network for 0/1 labels; every fifth row calibrates. A single class gives its smoothed share for all."""
    width = x.shape[1]
    rng = np.random.default_rng(seed)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))), 1.0)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    a, t = x[~held].astype(np.float64), y[~held].astype(np.float64)
    mean, spread = a.mean(0), a.std(0) + 1e-6
    a = (a - mean) / spread
    p = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array(np.log(t.mean() / (1 - t.mean())))]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for step in range(1, steps + 1):
        h = np.tanh(a @ p[0] + p[1])
        d = (sigmoid(h @ p[2] + p[3]) - t) / len(t)
        back = np.outer(d, p[2]) * (1 - h * h)
        grads = [a.T @ back + decay * p[0], back.sum(0), h.T @ d + decay * p[2], d.sum()]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, spread, p[0], p[1], p[2], float(p[3]), 1.0)
    fit = held if held.any() else ~held
    return net._replace(temperature=temperature(logits(x[fit].astype(np.float64), net), y[fit]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Token vectors over all documents, and the network from at most ``sample`` labelled ones."""
    table = vectors(*contexts(docs))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @tidy
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                rows = [r.tobytes() for r in pooled(block, shared.value)]
                at = slice(block.first, block.first + len(block))
                yield pa.RecordBatch.from_arrays([batch.column("label")[at], pa.array(rows, pa.binary()), batch.column("doc_id")[at]], ["label", "x", "doc_id"])

    kind = dict(docs.dtypes)["doc_id"]
    found = labelled(docs, labels, label, sample).select("doc_id", "label", "text").mapInArrow(features, f"label int, x binary, doc_id {kind}")
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "x").limit(sample).collect()
    x = np.frombuffer(b"".join(r.x for r in rows), np.float64).reshape(-1, WIDTH)
    net = train(x, np.array([r.label for r in rows], np.int64))
    del rows, x
    give_back()
    return table, net


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; with ``keep`` the columns of docs instead of doc_id and held_out.

    The score is the probability of label 1. A null or empty text has the vector
    0 and its score like any other. Without labelled rows every score is 0.5;
    with one class, its smoothed share. Repeated rows score alike. Extra columns
    are left out, or kept as they are with ``keep``; score and predicted then
    replace columns of these names. An empty table gives no rows.
    """
    table, net = fit(docs, labels, label, sample)
    shared = docs.sparkSession.sparkContext.broadcast((table, net))
    wanted = docs.drop("score", "predicted") if keep else docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text")
    names = [c for c in wanted.columns if keep or c != "text"]
    schema = ", ".join(f"`{n}` {t}" for n, t in wanted.dtypes if n in names) + ", score double, predicted int"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, net = shared.value
        for batch in batches:
            for block in blocks(batch.column("text")):
                p = probabilities(pooled(block, table), net)
                at = slice(block.first, block.first + len(block))
                columns = [batch.column(n)[at] for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    return wanted.mapInArrow(run, schema)
