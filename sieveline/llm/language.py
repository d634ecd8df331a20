"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

A text, lower-cased, is the counts of its hashed runs of 1 to 3 code points,
damped by a logarithm, weighted by inverse document frequency over all learning
documents and scaled to length 1. The regression is trained with
follow-the-regularised-leader and elastic-net penalties on a bounded sample: the
L1 part leaves most weights at exactly 0. A fifth of each language's sample sets
the temperature of the probabilities.

Every language of the learning rows is learned, however rare. The sample is
filled evenly: rare languages give all their rows, common ones an equal number.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import SUMS, fold, partial_sums, summed
from .text import U64, give_back, mix, tidy

BITS = 15
LONGEST = 3
#: Learning rows that the regression is trained on, at most, and their features that the driver gathers; more only where
#: so many languages share them that each would have fewer than LEAST. All the rows of a language with fewer are taken.
SAMPLE = 4000
LEAST = 50
#: Values of lang at most: weights are 32,768 numbers a language, of which the driver holds a few copies (0.13 GB each at most) and a worker one.
LANGUAGES = 512
FOLDS, HELD = 4, 2
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
TABLES = 32


class Model(NamedTuple):
    names: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a whole text and how often each stands in it."""
    x = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.uint64) + U64(1)
    found, run = [], None
    for n in range(1, LONGEST + 1):
        if len(x) < n:
            break
        run = x if run is None else run[:-1] * U64(0x9E3779B97F4A7C15) + x[n - 1 :]
        found.append(mix(run + U64(n << 56)) >> U64(64 - BITS))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.bincount(np.concatenate(found).astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at, total[at]


def weighted(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    return x / max(float(np.linalg.norm(x)), 1e-12)


def learning() -> Column:
    return (fold("doc_id", FOLDS) != HELD) & F.col("lang").isNotNull() & F.col("text").isNotNull()


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents of each feature, and all documents, over every learning row."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros((1 << BITS) + 1, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                df[counts(text.as_py())[0]] += 1
                n += 1
        df[-1] = n
        yield partial_sums(list(enumerate(np.array_split(df, TABLES))))

    parts = np.array_split(np.zeros((1 << BITS) + 1, np.int64), TABLES)
    for part, sums in summed(docs.filter(learning()).select("text").mapInArrow(count, SUMS), TABLES).items():
        parts[part] = sums
    df = np.concatenate(parts)
    return df[:-1], int(df[-1])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, alpha: float = 0.5, l1: float = 0.05, l2: float = 0.05, passes: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Weights by FTRL-proximal, one row at a time, each coordinate with its own rate."""
    z, n = np.zeros(((1 << BITS) + 1, classes)), np.zeros(((1 << BITS) + 1, classes))

    def solved(at: np.ndarray) -> np.ndarray:
        za = z[at]
        w = -(za - np.sign(za) * l1) / ((1.0 + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(za) <= l1, 0.0, w)

    for _ in range(passes):
        for (at, x), label in zip(rows, y, strict=True):
            at, x = np.append(at, 1 << BITS), np.append(x, 1.0)  # the last coordinate is the bias
            w = solved(at)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = solved(np.arange((1 << BITS) + 1))
    return w[:-1], w[-1]


def level(sizes: list[int], sample: int) -> int:
    """Rows of each language at most, so that together they are the sample; LEAST at least."""
    left, most = sample, 0
    for i, n in enumerate(sorted(sizes)):
        most = max(left, 0) // (len(sizes) - i)
        if n > most:
            return max(most, LEAST)
        left -= n
    return max(most, *sizes, LEAST)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the learning rows: text and lang of ids whose crc32 modulo 4 is not 2."""
    df, n = frequencies(docs)
    idf = np.log((n + 1) / (df + 1)) + 0.1

    @tidy
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([f[i].astype(np.int32).tobytes() for f in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("lang"), *columns], ["hash", "lang", "at", "n"])

    own = docs.filter(learning()).select("lang", "text", F.xxhash64("doc_id", "text", F.lit(10)).alias("hash"))
    sizes = {r.lang: r.n for r in own.groupBy("lang").agg(F.countDistinct("hash").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of lang: weights for all of them are held on the driver and by each worker")
    names = tuple(sorted(sizes))
    if not names:
        return Model((), idf, np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    most = level(list(sizes.values()), sample)
    # a language's hashes below its share are most rows and four standard errors, of which the first are used
    shares = docs.sparkSession.createDataFrame([(k, (most + 4 * most**0.5) / v) for k, v in sizes.items()], "lang string, share double")
    below = F.shiftrightunsigned("hash", 11) / float(1 << 53) < F.col("share")
    chosen = own.join(F.broadcast(shares), "lang").filter(below).select("hash", "lang", "text").dropDuplicates(["hash", "lang"])
    rows = chosen.mapInArrow(features, "hash long, lang string, at binary, n binary").collect()
    rows.sort(key=lambda r: (r.hash % (1 << 64), r.lang))
    turn, seen = [], dict.fromkeys(names, 0)
    for r in rows:
        turn.append(seen[r.lang])
        seen[r.lang] += 1
    rows = [(r, t) for r, t in zip(rows, turn, strict=True) if t < most]
    x = [(a := np.frombuffer(r.at, np.int32), weighted(a, np.frombuffer(r.n, np.int32), idf)) for r, _ in rows]
    y = np.array([names.index(r.lang) for r, _ in rows], np.int64)
    held = np.array([t % 5 == 4 for _, t in rows])
    del rows
    weights, bias = train([r for r, h in zip(x, held, strict=True) if not h], y[~held], len(names))
    scored = np.array([v @ weights[a] + bias for a, v in x])
    use = held if held.any() else ~held
    grid = np.exp(np.linspace(np.log(0.02), np.log(8), 80))
    del x
    give_back()
    loss = [-np.mean(np.log(softmax(scored[use] / t)[np.arange(use.sum()), y[use]] + 1e-12)) for t in grid]
    return Model(names, idf, weights, bias, float(grid[int(np.argmin(loss))]))


def identify(text: str | None, model: Model) -> tuple[str, float]:
    if not text or not model.names or not LETTER.search(text):
        return UNKNOWN, 0.0
    at, n = counts(text)
    p = softmax((weighted(at, n, model.idf) @ model.weights[at] + model.bias) / model.temperature)
    best = int(np.argmax(p))
    return model.names[best], float(p[best])


def predict(docs: DataFrame, sample: int = SAMPLE, keep: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; with ``keep`` the columns of docs instead of doc_id and held_out.

    A text that is null or has no letter is ``und`` with score 0, and so is every
    text if no row can be learned from. Otherwise the score is the probability
    of the language named; ties go to the first name. Repeated rows are named
    alike. Extra columns are left out, or kept with ``keep``; lang_pred and score
    then replace columns of these names. An empty table gives no rows. More than
    LANGUAGES values of lang to learn from are an error.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))
    wanted = docs.drop("lang_pred", "score") if keep else docs.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "text")
    names = [c for c in wanted.columns if keep or c != "text"]
    schema = ", ".join(f"`{n}` {t}" for n, t in wanted.dtypes if n in names) + ", lang_pred string, score double"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [identify(t.as_py(), model) for t in batch.column("text")]
            out = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *out], [*names, "lang_pred", "score"])

    return wanted.mapInArrow(run, schema)
