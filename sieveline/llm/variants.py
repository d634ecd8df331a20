"""Spelling variants: words one edit apart, joined by PartEnum signatures of their letters.

A word's multiset of letters is a binary vector with a place for each (letter,
occurrence). One replaced code point puts two such vectors at a Hamming distance
of exactly two, one inserted or deleted code point at one. The places are dealt
into ``PARTS`` parts by a fixed rule; vectors at distance two agree outside some
two parts, vectors at distance one outside some one part. So every choice of the
parts that are left out gives an exact signature, two words that are near share
one, and an equality join on signatures finds them all. Words with the same
letters share all signatures, so the join is over distinct multisets, whose words
travel in rows of about ``CHUNK``; pairs of rows whose vectors are too far apart
fall to a comparison of bits inside the join. What is left is verified on the
words: a near pair is alike once the letter that differs is blanked or dropped.

The corpus is read once, in blocks of whole texts; what is shuffled are words
with counts. Everything after grows with the vocabulary alone, and so do both
sides of every join: all are merged, as Spark takes the size of a packed table,
or one row's for all that it is exploded to, and would broadcast far more.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Tables
from .text import LOWER, Block, blocks, spans, spelled, tidy

#: A run whose hash this divides loses a code point.
DAMAGED = 199
#: Code points of a word, and occurrences, at least.
LEAST, OFTEN = 6, 5
#: A form has so many times the occurrences of the word.
TIMES = 5
#: Parts of the places; places of a letter lie STEP parts apart.
PARTS, STEP = 7, 3
#: Words of one multiset in a row of the join, on average.
CHUNK = 64
SPAN = 4 << 20

#: A-Z and a-z; in UTF-8, U+00C0 to U+00FF are this byte and one more.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LATIN = 0xC3


def counted(block: Block, ids: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words of LEAST or more code points of a block, after damage, with their occurrences; a word may come twice."""
    data = LOWER[block.data]
    kind = LETTER[data] | (data == LATIN)
    kind[1:] |= data[:-1] == LATIN
    w = spans(block, kind.astype(np.uint8))
    if not len(w.start):
        return [], np.zeros(0, np.int64)
    runs = spelled(data, kind, w)
    names, m = runs.dictionary.to_pylist(), len(runs.dictionary)
    own, n = np.unique(w.doc * m + runs.indices.to_numpy(), return_counts=True)
    doc, word = np.divmod(own, m)
    heads = [zlib.crc32(i) for i in ids]
    crc = np.fromiter((zlib.crc32(names[j], heads[i]) for i, j in zip(doc.tolist(), word.tolist(), strict=True)), np.int64, len(own))
    hit = crc % DAMAGED == 0
    total = np.bincount(word[~hit], n[~hit], m).astype(np.int64)
    out = [name for name, k in zip(names, total.tolist(), strict=True) if k]
    damaged = []
    for j, h in zip(word[hit].tolist(), crc[hit].tolist(), strict=True):
        run = names[j].decode()
        damaged.append((run[: h % len(run)] + run[h % len(run) + 1 :]).encode())
    return out + damaged, np.concatenate([total[total > 0], n[hit]])


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n: how often each word of LEAST or more code points occurs in all texts."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [f"{i}:".encode() for i in batch.column("id").to_pylist()]
            for block in blocks(batch.column("text"), SPAN):
                names, n = counted(block, ids[block.first : block.first + len(block)])
                names = pa.array(names, pa.binary()).cast(pa.string())
                long = pc.greater_equal(pc.utf8_length(names), LEAST)
                yield pa.RecordBatch.from_arrays([names.filter(long), pa.array(n, pa.int64()).filter(long)], ["word", "n"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def part(letter: str, occurrence: int) -> int:
    return (ord(letter) + STEP * occurrence) % PARTS


def letter_rows(words: DataFrame) -> DataFrame:
    """letters (in order), size, bits, parts (a hash of each part), whole (of all) and words of every chunk of every multiset."""
    lettered = words.withColumn("letters", F.array_join(F.array_sort(F.split("word", "")), ""))
    sized = lettered.groupBy("letters").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    rows = lettered.join(sized.hint("merge"), "letters").groupBy("letters", F.pmod(F.xxhash64("word"), F.col("chunks")).alias("chunk")).agg(F.collect_list(F.struct("word", "n")).alias("words"))

    def place(c: Column, i: Column) -> Column:
        k = i - F.instr(F.col("letters"), c) + 2
        return F.struct(F.pmod(F.ascii(c) + STEP * k, F.lit(PARTS)).alias("part"), F.xxhash64(c, k).alias("h"))

    def joined(own: Column) -> Column:
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x["h"]))

    places = F.transform(F.split("letters", ""), place)
    bit = F.aggregate("places", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x["h"], F.lit(64)).cast("int"))))

    def of_part(p: int) -> Column:
        return joined(F.filter("places", lambda x: x["part"] == p))

    parts = F.array(*[of_part(p) for p in range(PARTS)])
    return rows.withColumn("places", places).select("letters", F.length("letters").alias("size"), bit.alias("bits"), parts.alias("parts"), joined(F.col("places")).alias("whole"), "words")


def signatures(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join: a row for each signature, with its key and its number.

    Words of one size meet in the signatures without two parts, which are
    numbered p * PARTS + q. A word and one longer by a letter meet in those
    without one part, numbered p * PARTS + p, by the shorter one's size.
    """
    def side(less: int) -> DataFrame:
        each = []
        for p in range(PARTS):
            for q in range(p, PARTS):
                rest = F.col("whole").bitwiseXOR(F.col("parts")[p])
                rest, size = (rest.bitwiseXOR(F.col("parts")[q]), F.col("size")) if p < q else (rest, F.col("size") - less)
                each.append(F.struct(F.xxhash64(rest, F.lit(p * PARTS + q), size).alias("key"), F.lit(p * PARTS + q).alias("number")))
        return rows.withColumn("s", F.explode(F.array(*each))).select("s.key", "s.number", "letters", "size", "bits", "words")

    return side(0), side(1)


def apart(a: str, b: str) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """Places of a alone and of b alone; both strings are in order."""
    only_a, only_b = [], []
    for c in {*a, *b}:
        m, n = a.count(c), b.count(c)
        only_a += [(c, k) for k in range(n + 1, m + 1)]
        only_b += [(c, k) for k in range(m + 1, n + 1)]
    return only_a, only_b


def first_number(places: list[tuple[str, int]]) -> int:
    """The least number among the signatures that leave out the parts of these places, so that a pair counts once."""
    parts = sorted({part(*place) for place in places})
    if len(places) == 1:
        return parts[0] * PARTS + parts[0]
    if len(parts) == 2:
        return parts[0] * PARTS + parts[1]
    return min(parts[0], 1) * parts[0] + (1 if parts[0] == 0 else 0)


def verified(number: int, a: str, words: list, b: str, others: list) -> list[tuple]:
    """The near pairs (word, n, other, other's n) of two rows of words that meet in a signature."""
    gone, come = apart(a, b)
    if len(gone) + len(come) != 1 + (len(a) == len(b)) or first_number(gone + come) != number:
        return []
    y = come[0][0]
    known: dict[str, list] = {}
    for w in words:
        if not gone:
            known.setdefault(w["word"], []).append(w)
            continue
        for i, c in enumerate(w["word"]):
            if c == gone[0][0]:
                known.setdefault(w["word"][:i] + "\0" + w["word"][i + 1 :], []).append(w)
    out = []
    for o in others:
        blank = "\0" if gone else ""
        for form in {o["word"][:i] + blank + o["word"][i + 1 :] for i, c in enumerate(o["word"]) if c == y}:
            out += [(w["word"], w["n"], o["word"], o["n"]) for w in known.get(form, ())]
    return out


def near_pairs(rows: DataFrame) -> DataFrame:
    """word, n, other, other_n: every pair of words one edit apart, once, from letter_rows."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("number", "letters", "words", "b_letters", "b_words")]
            out = [pair for row in zip(*columns, strict=True) for pair in verified(*row)]
            values = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n", "other", "other_n"])

    left, right = signatures(rows)
    right = right.select("key", *[F.col(c).alias(f"b_{c}") for c in right.columns if c != "key"])
    close = F.bit_count(F.col("bits").bitwiseXOR(F.col("b_bits"))) <= 2
    once = (F.col("size") < F.col("b_size")) | ((F.col("size") == F.col("b_size")) & (F.col("letters") < F.col("b_letters")))
    met = left.join(right.hint("merge"), (left["key"] == right["key"]) & (F.col("number") == F.col("b_number")) & once & close)
    return met.select("number", "letters", "words", "b_letters", "b_words").mapInArrow(run, "word string, n long, other string, other_n long")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word.

    A null or empty text has no words; a row without doc_id is hashed with an
    empty one; rows that repeat an id are documents of their own. Ties between
    near words of one count go to the smallest in code-point order. Extra columns
    are left out, and an empty table gives no rows.
    """
    tables = Tables(docs.sparkSession)
    words = tables.keep("words", word_counts(docs).filter(F.col("n") >= OFTEN))
    pairs = tables.keep("pairs", near_pairs(tables.keep("letters", letter_rows(words))))
    ways = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = ways.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    rows = words.join(best.hint("merge"), "word", "left")
    has = -F.col("best.less") >= TIMES * F.col("n")
    rows = tables.keep("forms", rows.select("word", F.when(has, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, -F.col("best.less")).alias("form_n")))
    roots = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # each step multiplies n, so the longest way is known beforehand, and each round doubles what is followed
    most = rows.agg(F.max("n")).first()[0] or 1
    for turn in range(math.ceil(math.log2(max(1, math.log(most, TIMES)) + 1))):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        roots = tables.keep(f"roots{turn}", roots.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("ahead", "root").alias("root")))
        if turn:
            tables.drop(f"roots{turn - 1}")
    return rows.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def sql() -> str:
    """DuckDB SQL of the query: CRC-32 by a table, near words by blanked and by dropped code points."""
    return f"""
WITH RECURSIVE crc_steps AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
    UNION ALL SELECT i, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM crc_steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM crc_steps WHERE k = 8),
r AS (SELECT row_number() OVER () AS row, coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT id, run, count(*) AS k FROM r GROUP BY ALL),
b AS (SELECT id, run, k, flatten(list_transform(string_split(id || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195::BIGINT, (unicode(ch) - 64)::BIGINT] END)) AS bytes FROM g),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda acc, x: xor(acc >> 8, tab[(xor(acc, x) & 255) + 1])), 4294967295) AS h FROM b, crc),
d AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM d WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(k) >= {OFTEN}),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
gaps AS (SELECT DISTINCT word, n, word[:i - 1] || word[i + 1:] AS rest FROM p),
blanks AS (SELECT word, n, word[:i - 1] || '*' || word[i + 1:] AS rest FROM p),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM blanks a JOIN blanks b ON a.rest = b.rest AND a.word <> b.word
    UNION ALL SELECT g.word, g.n, v.word, v.n FROM gaps g JOIN v ON g.rest = v.word
    UNION ALL SELECT v.word, v.n, g.word, g.n FROM gaps g JOIN v ON g.rest = v.word),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS place FROM near),
forms AS (SELECT v.word, CASE WHEN other_n >= {TIMES} * v.n THEN other END AS form, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= {TIMES} * v.n THEN other_n END AS form_n FROM v LEFT JOIN ranked ON ranked.word = v.word AND place = 1),
follow AS (SELECT word, word AS root FROM forms UNION ALL SELECT follow.word, f.form FROM follow JOIN forms f ON f.word = follow.root WHERE f.form IS NOT NULL),
ends AS (SELECT follow.word, root FROM follow JOIN forms f ON f.word = root WHERE f.form IS NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""
