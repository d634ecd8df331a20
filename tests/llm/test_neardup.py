import random
import re

import numpy as np
import pyarrow as pa
import pytest

from plain import brute, word_sets

from sieveline.llm import neardup
from sieveline.llm.components import components
from sieveline.llm.skew import joined
from sieveline.llm.text import blocks, exact_sets, shingles, word_digests


def corpus(seed=0, n=260):
    """Copies edited more and more, chains, shared passages, short and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    passage = [word() for _ in range(60)]
    rows, key = [], iter(rng.sample(range(10_000), 2 * n))
    for _ in range(n // 20):
        base = [word() for _ in range(rng.choice([8, 30, 120, 400]))]
        for edits in range(12):
            own = list(base)
            for _ in range(rng.randrange(0, 2 + edits * len(base) // 60)):
                own[rng.randrange(len(own))] = word()
            rows.append((next(key), " ".join(own)))
        for _ in range(6):
            rows.append((next(key), " ".join([*[word() for _ in range(rng.randrange(5, 90))], *passage, word()])))
        chain = list(base)
        for _ in range(4):  # each is close to the one before alone
            chain[rng.randrange(len(chain))] = word()
            rows.append((next(key), "  ".join(chain).upper()))
    return rows


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (8, "a b c d"), (9, "a b c d e"), (None, "a b c d"), (8, "a b c d"), (8, "x"), (11, "é É"), (12, "é é")]


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_that_cancel_in_sums_are_not_linked(spark):
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, other), (3, "a b c d e f")] + [(10 + i, f"{w} {w} x y z") for i, w in enumerate((one, other))]
    for k in (4, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted((tuple(r) for r in neardup.near_components(docs, k).collect()), key=repr) == brute(rows, k)


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
@pytest.mark.parametrize("k", [1, 4, 5])
def test_exact_sets_and_digests_are_of_words(size, k):
    texts = [t for _, t in corpus(5, 40)] + [None, "", " ", "One two", " one  TWO\t", "one two three four", "é É", thue_morse(300)]
    for block in blocks(pa.array(texts), size):
        found = exact_sets(block, k)
        sets = [word_sets(texts[block.first + i], k) for i in range(len(block))]
        for i in range(len(block)):
            for j in range(i, min(i + 14, len(block))):
                assert len(np.intersect1d(found[i], found[j])) == len(sets[i] & sets[j])
    digests = [d for block in blocks(pa.array(texts), size) for d in word_digests(block)]
    words = [" ".join(re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for t in texts]
    assert len(set(digests)) == len(set(words)) == len(set(zip(digests, words, strict=True)))


@pytest.mark.parametrize("rows", [corpus() + ODD, corpus(7), ODD, [(5, "a b c d e f " * 9000), (3, "a b c d e f " * 9001)], []])
def test_matches_all_pairs(spark, rows):
    docs = spark.createDataFrame([(i, t, "k", 0, b"") for i, t in rows], "doc_id long, text string, key string, node int, registers binary")
    found = [tuple(r) for r in neardup.near_components(docs).collect()]
    assert sorted(found, key=repr) == brute(rows)


def test_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "ROWS", 3)
    monkeypatch.setattr(neardup, "BYTES", 2000)
    monkeypatch.setattr(neardup, "ROUNDS", 1)
    rows = corpus(3, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in neardup.near_components(docs, k=5).collect()), key=repr) == brute(rows, 5)


def test_shingles_match_words():
    texts = ["One two  three\tfour five", "a", "", "x y z", "tail of the last one here"]
    for block in blocks(pa.array(texts), 16):
        for k in (1, 4, 5):
            found, at = shingles(block, k)
            for i in range(len(block)):
                assert len(set(found[at[i] : at[i + 1]].tolist())) == len(word_sets(texts[block.first + i], k))


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for share in (0.2, 0.5, 0.8, 0.95):
        b = np.concatenate([a[: int(3000 * share)], rng.integers(0, 1 << 63, 3000 - int(3000 * share), dtype=np.uint64)])
        x, y = neardup.registers(a), neardup.registers(b)
        assert (np.maximum(x, y) == neardup.registers(np.union1d(a, b))).all()
        got = neardup.likeness((x > y).sum(keepdims=True), (x < y).sum(keepdims=True), (x == y).sum(keepdims=True), np.array([3000.0]), np.array([3000.0]))
        assert abs(got[0] - share / (2 - share)) < 0.12


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(7, 7)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    want = {i: root(i) for i in list(parent)}
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == want


def test_components_that_are_not_finished_are_an_error(spark):
    path = spark.range(40).selectExpr("id AS a", "id + 1 AS b")
    with pytest.raises(RuntimeError, match="round 1"):
        components(path, most=1)
    assert {r.component for r in components(path).collect()} == {0}


def test_joins_on_hot_keys(spark, monkeypatch):
    from sieveline.llm import skew

    monkeypatch.setattr(skew, "SHARE", 5)
    monkeypatch.setattr(skew, "SALTS", 4)
    rows = spark.range(1000).selectExpr("id AS node", "CASE WHEN id < 600 THEN 1 WHEN id < 990 THEN id END AS key")
    unique = rows.filter("key IS NOT NULL").groupBy("key").count().selectExpr("key", "count AS n", "key * 2 AS twice")
    found = joined(rows, unique, "key", "node", 1000)
    counted = joined(rows.join(unique.select("key", "n"), "key"), unique, "key", "node", 1000, counted=True)
    assert found.columns == counted.columns == ["key", "node", "n", "twice"]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, counted.collect())) == sorted((k, i, 600 if k == 1 else 1, 2 * k) for i in range(990) for k in [1 if i < 600 else i])
