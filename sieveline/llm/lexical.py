"""Ranked lexical search: the best documents of each item by integer BM25-like scores, by presence masks.

One pass over the texts keeps of each document the number of its terms, and the
terms that some item asks for with their occurrences; corpus statistics (N, L and
df) come from that table by counts that combine map-side. A second pass over the
table ranks. In every run of documents a term's bitmap marks who holds it, and
the bitmaps of an item's terms, side by side, give each document a mask. All
documents of one mask share an upper bound, the sum over its terms of the largest
part of a score that the term has in the run. Masks are evaluated by falling
bound until it lies below the item's K-th best score so far, which goes on from
run to run of a task, so later runs evaluate few masks or none. Ties are kept as
a bound equal to that score is still evaluated. A task emits K rows an item; they
meet in two steps, so no item's rows of all tasks are sorted in one place.

Items are the query set: they go to the tasks in blocks of bounded rows and
bytes, with a pass each, against all documents.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Tables
from .text import LOWER, blocks, spans, spelled, tidy

K = 20
#: Items, and bytes of their texts, in a block, on average.
ITEMS, BYTES = 4096, 8 << 20
#: Documents of a run, and documents that are evaluated at once, at least.
RUN, STEP = 4096, 64
#: Parts in which a task's best rows meet first.
SALTS = 64
SPAN = 4 << 20
#: ASCII letters and digits and all bytes above ASCII make terms.
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text: str | None) -> list[str]:
    return TERMS.findall((text or "").translate(ASCII_LOWER))


def matched(docs: DataFrame, known: list[bytes]) -> DataFrame:
    """doc_id, n (all terms), terms (numbers of the known ones) and tfs of every document that has a term."""
    kind, names = dict(docs.dtypes)["doc_id"], pa.array(known, pa.large_binary())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), SPAN):
                data = LOWER[block.data]
                w = spans(block, TERM[data].astype(np.uint8))
                all_terms = spelled(data, TERM[data], w)
                number = pc.fill_null(pc.index_in(all_terms.dictionary, value_set=names), -1).to_numpy().astype(np.int64)
                number = number[all_terms.indices.to_numpy()]
                asked = number >= 0
                own, tf = np.unique(w.doc[asked] * len(known) + number[asked], return_counts=True)
                doc, term = np.divmod(own, max(len(known), 1))
                at = pa.array(np.searchsorted(doc, np.arange(len(block) + 1)), pa.int32())
                columns = [
                    batch.column("doc_id")[block.first : block.first + len(block)],
                    pa.array(np.diff(w.before), pa.int64()),
                    pa.ListArray.from_arrays(at, pa.array(term, pa.int32())),
                    pa.ListArray.from_arrays(at, pa.array(tf, pa.int32())),
                ]
                out = pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pc.greater(out.column("n"), 0))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


def statistics(rows: DataFrame, known: int) -> tuple[int, int, list[int]]:
    """N, L, and the df of each known term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(known, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=known)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df), pa.int32()), pa.array(df[df > 0])], ["term", "df"])

    documents, length = rows.agg(F.count("*"), F.sum("n")).first()
    held = rows.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = [0] * known
    for term, df in held.collect():
        out[term] = df
    return documents, length or 0, out


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Best:
    """The K best (score, doc_id) so far; equal scores by ascending doc_id, null last."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        """No row with a lower score can come in."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.rows = heapq.nsmallest(self.k, [*self.rows, *zip(scores.tolist(), ids, strict=True)], key=lambda r: (-r[0], r[1] is None, r[1]))


def rank_run(items: list[tuple[np.ndarray, np.ndarray]], best: list[Best], ids: pa.Array, size: np.ndarray, doc: np.ndarray, term: np.ndarray, part: np.ndarray, known: int) -> None:
    """Take a run of documents into the best rows of each item.

    doc, term and part are the postings: a document of the run, its term and
    floor(1e9 tf / (1000 tf + 12 m)). An item is its terms and their weights,
    times repeats.
    """
    order = np.argsort(term, kind="stable")
    doc, part = doc[order], part[order]
    first = np.searchsorted(term[order], np.arange(known + 1))
    top = np.zeros(known, np.int64)
    held = first[1:] > first[:-1]
    if held.any():
        top[held] = np.maximum.reduceat(part, first[:-1][held])
    for (own, w), found in zip(items, best, strict=True):
        most = w * top[own]
        if most.sum() < found.least:
            continue
        use = np.flatnonzero(most)
        own, w, most = own[use], w[use], most[use]
        mask = np.zeros((len(size), len(own) // 64 + 1), np.uint64)
        for j, t in enumerate(own):
            mask[doc[first[t] : first[t + 1]], j // 64] |= np.uint64(1 << j % 64)
        kinds, kind = np.unique(mask[:, 0] if mask.shape[1] == 1 else mask, axis=0, return_inverse=True)
        bits = np.unpackbits(np.ascontiguousarray(kinds).view(np.uint8).reshape(len(kinds), -1), axis=1, bitorder="little")[:, : len(own)]
        bound = (bits * most).sum(1)
        by_kind = np.argsort(-bound, kind="stable")
        members = np.argsort(np.argsort(by_kind)[kind.reshape(-1)], kind="stable")  # documents by falling bound of their masks
        ends = np.cumsum(np.bincount(kind.reshape(-1), minlength=len(kinds))[by_kind])
        falling, at, done = bound[by_kind], 0, 0
        while at < len(ends) and falling[at] >= found.least:
            to = min(max(at + 1, int(np.searchsorted(ends, done + STEP))), len(ends))
            to = at + max(1, int((falling[at:to] >= found.least).sum()))
            some = np.sort(members[done : ends[to - 1]])
            score = np.zeros(len(some), np.int64)
            for t, v in zip(own, w, strict=True):
                a, b = first[t], first[t + 1]
                place = np.minimum(np.searchsorted(doc[a:b], some), b - a - 1)
                score += np.where(doc[a:b][place] == some, v * part[a:b][place], 0)
            keep = score >= found.least
            if keep.any():
                found.add(score[keep], ids.take(pa.array(some[keep])).to_pylist())
            at, done = to, ends[to - 1]


def best_of_tasks(rows: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], known: int, documents: int, length: int, k: int) -> DataFrame:
    """item (its number), doc_id and score of the K best documents of each item in each task."""
    kind = dict(rows.dtypes)["doc_id"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, form = [Best(k) for _ in items], pa.int64()
        for whole in batches:
            form = whole.schema.field("doc_id").type
            for batch in (whole[i : i + RUN] for i in range(0, len(whole), RUN)):
                n = batch.column("n").to_numpy()
                m = 75 + np.array([25 * x * documents // length for x in n.tolist()], np.int64)
                lists = batch.column("terms")
                doc = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy())
                tf = batch.column("tfs").flatten().to_numpy().astype(np.int64)
                part = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
                rank_run(items, best, batch.column("doc_id"), n, doc, lists.flatten().to_numpy(), part, known)
        out = [(i, doc_id, score) for i, found in enumerate(best) for score, doc_id in found.rows]
        values = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(values[0], pa.int32()), pa.array(values[1], form), pa.array(values[2], pa.int64())], ["item", "doc_id", "score"])

    return rows.mapInArrow(run, f"item int, doc_id {kind}, score long")


def search(items: DataFrame, docs: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of every item.

    Documents whose score is 0 aren't ranked. A null or empty text has no terms,
    so an item without terms, or none that a document holds, has no rows. Equal
    scores are ranked by ascending doc_id, null last. Rows that repeat an id, of
    items or of documents, are items and documents of their own. Extra columns
    are left out; empty tables give no rows.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    asked = tables.keep("items", items.select("item_id", "text").withColumn("at", F.monotonically_increasing_id()))
    count, size = asked.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(1, math.ceil(count / ITEMS), math.ceil((size or 0) / BYTES))
    out = spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id {dict(docs.dtypes)['doc_id']}, score long")
    for block in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("at"), F.lit(parts)) == block).orderBy("at").collect()
        own = [Counter(terms(r["text"])) for r in rows]
        number = {t: i for i, t in enumerate(sorted({t for c in own for t in c}))}
        if not number:
            continue
        found = tables.keep(f"matched{block}", matched(docs, [t.encode() for t in number]))
        documents, length, df = statistics(found, len(number))
        if not documents:
            continue
        weighted = [(np.array([number[t] for t in c], np.int64), np.array([n * weight(documents, df[number[t]]) for t, n in c.items()], np.int64)) for c in own]
        best = best_of_tasks(found, weighted, len(number), documents, length, k)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        some = best.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(SALTS)))
        some = some.withColumn("r", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("r") <= k)
        last = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {dict(items.dtypes)['item_id']}")
        done = tables.keep(f"ranked{block}", last.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
        tables.drop(f"matched{block}")
        out = out.unionByName(done)
    return out


def sql() -> str:
    """DuckDB SQL of the query, by joining terms."""
    return f"""
WITH split AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
t AS (SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{{00}}-\\x{{2F}}\\x{{3A}}-\\x{{40}}\\x{{5B}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]+')) AS term FROM split),
c AS (SELECT side, id, term, count(*) AS k FROM t GROUP BY ALL),
d AS (SELECT id AS doc_id, term, k AS tf FROM c WHERE side = 'd'),
size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM d GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM size),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM d, corpus GROUP BY term, docs),
s AS (SELECT c.id AS item_id, d.doc_id, sum(c.k * w.w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * (75 + (25 * n * docs) // length))))::BIGINT AS score
    FROM c JOIN d USING (term) JOIN w USING (term) JOIN size USING (doc_id), corpus WHERE c.side = 'i' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= {K}"""
