"""Toxicity: non-negative learning from confirmed toxic and unlabelled texts.

Only toxic labels are used as examples; everything else is unlabelled text, of
which a known share (the class prior, counted over all labels of the learning
folds) is toxic too. The risk of calling a text toxic is therefore estimated on
unlabelled texts and corrected by the prior; where that estimate falls below 0,
which only overfitting brings about, the step goes back instead. A few linear
classifiers in numpy, each with its own order of examples, are averaged.

A text is the set of its hashed words and word beginnings, case of A-Z apart.
Of those, the ones by which toxic and unlabelled examples differ most are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_checkpoint
from .labels import fold, labelled, once
from .quality import KIND, sigmoid
from .text import LOWER, U64, Block, blocks, mix, span_hashes, spans, tidy

BITS = 18
#: Bytes of the word beginnings that count beside whole words.
BEGINNINGS = (4, 5, 6)
KEPT = 2048
#: Confirmed toxic rows, and unlabelled rows, that the classifiers learn from, at most.
POSITIVE = 4000
UNLABELLED = 12000
#: A feature counts from this many standard errors, and times, more often in toxic texts.
ERRORS = 4.0
RATIO = 2.0
THRESHOLD = 0.5
TASKS = 16


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature and document of every word and word beginning, repeats kept."""
    kind = KIND[block.data]
    w = spans(block, kind)
    word = kind[w.start] == 1
    start, end, doc = w.start[word], w.end[word], w.doc[word]
    data = LOWER[block.data]
    found, docs = [span_hashes(data, start, end)], [doc]
    for k in BEGINNINGS:
        long = end - start > k
        found.append(mix(span_hashes(data, start[long], start[long] + k) + U64(k)))
        docs.append(doc[long])
    return (np.concatenate(found) >> U64(64 - BITS)).astype(np.int64), np.concatenate(docs)


def sets(block: Block, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct wanted features of each document, as (document, feature) in order."""
    feature, doc = features(block)
    keep = wanted[feature]
    both = np.unique(doc[keep] << BITS | feature[keep])
    return both >> BITS, both & ((1 << BITS) - 1)


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, seeds: int = 3, decay: float = 3e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of the averaged classifiers, from 0/1 rows.

    Each classifier sees its own four fifths of the examples, all at once in
    every step: on few examples the corrected risk falls below 0 by chance alone.
    """
    width = positive.shape[1]
    if not len(positive) or not len(unlabelled):
        return np.zeros(width), float(np.log(prior / (1 - prior)))
    total, bias = np.zeros(width), 0.0
    for seed in range(seeds):
        rng = np.random.default_rng(seed)
        p, u = (x[rng.permutation(len(x))[: max(1, len(x) * 4 // 5)]].astype(np.float32) for x in (positive, unlabelled))
        w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
        for step in range(1, steps + 1):
            own = w[:-1].astype(np.float32)
            zp, zu = (p @ own).astype(np.float64) + w[-1], (u @ own).astype(np.float64) + w[-1]
            # logistic losses: of being missed for toxic rows, of being called toxic for the rest
            negative = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
            gu, gp = sigmoid(zu) / len(zu), -prior * sigmoid(zp) / len(zp)
            if negative < 0:
                gu, gp = -gu, -gp
            else:
                gp = gp - prior * sigmoid(-zp) / len(zp)
            g = np.append((gp.astype(np.float32) @ p + gu.astype(np.float32) @ u).astype(np.float64), gp.sum() + gu.sum())
            g[:-1] += decay * w[:-1]
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        total += w[:-1] / seeds
        bias += w[-1] / seeds
    scale, shift = calibrate(positive @ total + bias, unlabelled @ total + bias, prior)
    return total * scale, bias * scale + shift


def calibrate(zp: np.ndarray, zu: np.ndarray, prior: float, steps: int = 800) -> tuple[float, float]:
    """Scale and shift of the logits with the least corrected risk over all examples.

    The weights are held small against overfitting, which leaves the logits too
    flat; two numbers can't overfit.
    """
    q, m, v = np.array([1.0, 0.0]), np.zeros(2), np.zeros(2)
    for step in range(1, steps + 1):
        p, u = sigmoid(q[0] * zp + q[1]), sigmoid(q[0] * zu + q[1])
        negative = np.mean(-np.log1p(-np.minimum(u, 1 - 1e-12))) - prior * np.mean(-np.log1p(-np.minimum(p, 1 - 1e-12)))
        back = np.array([np.mean(u * zu) - prior * np.mean(p * zp), np.mean(u) - prior * np.mean(p)])
        g = -back if negative < 0 else back - prior * np.array([np.mean((1 - p) * zp), np.mean(1 - p)])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        q -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        q[0] = max(q[0], 0.1)
    return float(q[0]), float(q[1])


def choose(positive: np.ndarray, unlabelled: np.ndarray, n_positive: int, n_unlabelled: int, kept: int = KEPT) -> np.ndarray:
    """The features whose share of toxic documents most exceeds that of unlabelled ones, for its error."""
    a, b = (positive + 0.5) / (n_positive + 1), (unlabelled + 0.5) / (n_unlabelled + 1)
    z = (a - b) / np.sqrt(a * (1 - a) / (n_positive + 1) + b * (1 - b) / (n_unlabelled + 1))
    z[(positive < 2) & (unlabelled < 20)] = 0
    z[a < RATIO * b] = 0
    order = np.argsort(-z, kind="stable")[:kept]
    return np.sort(order[z[order] > ERRORS])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", positive: int = POSITIVE, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, float]:
    """A weight for every hashed feature, and the bias."""
    learning = labels.filter((fold("doc_id", 5) != 0) & F.col(label).isNotNull())
    counted = learning.agg(F.count("*").alias("n"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("k")).first()
    prior = ((counted.k or 0) + 1) / (counted.n + 2)
    toxic = labelled(docs, labels, label, positive, only=1).select("doc_id", "text", F.lit(1).alias("is"))
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id", F.lit(6)), "doc_id").limit(unlabelled)
    rest = once(docs, ids).select("doc_id", "text", F.lit(0).alias("is"))
    # ordered, so that reruns train alike; the sample has one row an id, and the ids are bounded by the two parameters
    sample = toxic.unionByName(rest).repartition(TASKS, F.xxhash64("doc_id")).sortWithinPartitions("is", "doc_id", "text")
    sample = shared_checkpoint(sample)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, totals, rows = np.ones(1 << BITS, bool), np.zeros((2, 1 << BITS), np.int32), [0, 0]
        for batch in batches:
            for block in blocks(batch.column("text")):
                kinds = batch.column("is")[block.first : block.first + len(block)].to_numpy()
                doc, feature = sets(block, every)
                for k in (0, 1):
                    totals[k] += np.bincount(feature[kinds[doc] == k], minlength=1 << BITS).astype(np.int32)
                    rows[k] += int((kinds == k).sum())
        yield pa.RecordBatch.from_arrays([pa.array([totals.tobytes()], pa.binary()), pa.array([rows[0]]), pa.array([rows[1]])], ["df", "u", "p"])

    df, n = np.zeros((2, 1 << BITS), np.int64), [0, 0]
    for row in sample.select("text", "is").mapInArrow(count, "df binary, u long, p long").toLocalIterator():  # TASKS rows
        df += np.frombuffer(row.df, np.int32).reshape(2, -1)
        n = [n[0] + row.u, n[1] + row.p]
    chosen = choose(df[1], df[0], n[1], n[0])
    wanted = np.zeros(1 << BITS, bool)
    wanted[chosen] = True
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    @tidy
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                doc, feature = sets(block, shared.value)
                cut = np.searchsorted(doc, np.arange(len(block) + 1))
                found = [feature[cut[i] : cut[i + 1]].astype(np.int32) for i in range(len(block))]
                at = slice(block.first, block.first + len(block))
                yield pa.RecordBatch.from_arrays([batch.column("is")[at], pa.array(found, pa.list_(pa.int32())), batch.column("doc_id")[at]], ["is", "x", "doc_id"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = sample.mapInArrow(mark, f"is int, x array<int>, doc_id {kind}").collect()  # bounded rows of at most KEPT features
    rows.sort(key=lambda r: (r["is"], r.doc_id, r.x))
    sides = []
    for k in (1, 0):
        own = [r.x for r in rows if r["is"] == k]
        table = np.zeros((len(own), len(chosen)), np.uint8)
        for i, x in enumerate(own):
            table[i, np.searchsorted(chosen, x)] = 1
        sides.append(table)
    weights, bias = train(*sides, prior)
    out = np.zeros(1 << BITS)
    out[chosen] = weights
    return out, bias


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD, positive: int = POSITIVE, unlabelled: int = UNLABELLED) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    A null or empty text has no features and the score of the bias, like a text
    without any known word. Without toxic labels every score is the prior's.
    Repeated rows score alike; extra columns are left out; an empty table gives
    no rows.
    """
    weights, bias = fit(docs, labels, label, positive, unlabelled)
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))
    wanted = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), docs["text"].alias("text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        known = weights != 0
        for batch in batches:
            for block in blocks(batch.column("text")):
                doc, feature = sets(block, known)
                p = sigmoid(np.bincount(doc, weights[feature], len(block)) + bias)
                at = slice(block.first, block.first + len(block))
                columns = [batch.column("doc_id")[at], batch.column("held_out")[at], pa.array(p), pa.array((p >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return wanted.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
