import random

import numpy as np
import pytest
from plain import brute
from test_neardup import ODD, corpus

from sieveline.llm import neardup, ngram_join


@pytest.mark.parametrize("rows", [corpus() + ODD, [(5, "a b c d e f " * 9000), (3, "a b c d e f " * 9001)], []])
def test_matches_all_pairs(spark, rows):
    docs = spark.createDataFrame([(i, t, "k", 0, b"") for i, t in rows], "doc_id long, text string, key string, node int, sketch binary")
    found = sorted((tuple(r) for r in ngram_join.join(docs).collect()), key=repr)
    assert found == sorted((r[:3] for r in brute(rows, 4, 85)), key=repr)


def test_open_regions_are_compared_in_blocks(spark, monkeypatch):
    for name, value in (("ROWS", 3), ("BYTES", 2000), ("ROUNDS", 1), ("PIECE", 500)):
        monkeypatch.setattr(neardup, name, value)
    monkeypatch.setattr(ngram_join, "LEAF", 2)
    rows = corpus(3, 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((tuple(r) for r in ngram_join.join(docs, 3).collect()), key=repr)
    assert found == sorted((r[:3] for r in brute(rows, 3, 85)), key=repr)


def near(rng, n, shared, more):
    """Two sets of hashes of n and shared + more members with so many in common."""
    every = rng.integers(0, 1 << 64, n + more, dtype=np.uint64)
    return np.unique(every[:n]), np.unique(np.concatenate([every[:shared], every[n:]]))


def test_linked_sets_share_a_region_and_pass_the_bound():
    rng = np.random.default_rng(5)
    for n in [*range(1, 60), 100, 390, 700, 3000, 20_000]:
        for _ in range(30 if n < 400 else 4):
            shared = n - int(rng.integers(0, n * 15 // 100 + 1))
            more = int(rng.integers(0, n // 5 + 1))
            a, b = near(rng, n, shared, more)
            both = len(np.intersect1d(a, b))
            x, y = (ngram_join.point(s, 85).tobytes() for s in (a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                assert len(np.intersect1d(ngram_join.keys_of(x), ngram_join.keys_of(y)))
                assert ngram_join.maybe([x], np.array([len(a)]), y, len(b), 85)[0]
    a, b = near(rng, 1000, 500, 500)
    x, y = (ngram_join.point(s, 85).tobytes() for s in (a, b))
    assert not ngram_join.maybe([x], np.array([1000]), y, 1000, 85)[0]


def test_tree_keeps_every_pair_of_the_bound():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 12, (20, 64))
    x, y = (np.maximum(base[rng.integers(0, 20, n)] + rng.integers(-1, 2, (n, 64)) * (rng.random((n, 64)) < 0.2), 0).astype(np.int32) for n in (150, 170))
    nx, ny = x.sum(1), y.sum(1)
    want = {(i, j) for i in range(150) for j in range(170) if 185 * int(np.minimum(x[i], y[j]).sum()) >= 85 * int(nx[i] + ny[j])}
    assert {(int(i), int(j)) for i, others in ngram_join.tree_pairs(x, nx, y, ny, 85) for j in others} == want
    assert len(want) > 300


def test_counts_that_are_cut_bound_nothing():
    one = np.arange(1 << 17, dtype=np.uint64) << np.uint64(40)  # all in one group
    sketch = ngram_join.point(one, 85).tobytes()
    assert ngram_join.counts_of(sketch).max() == ngram_join.MOST
    assert ngram_join.maybe([sketch], np.array([len(one)]), sketch, len(one), 85)[0]


def test_a_round_makes_one_pair_a_class(spark):
    """A group of many near copies: each class meets one other, mostly the same, not one a bucket."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(1500):
        own = list(base)
        own[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    for method, made in ((neardup.Method(4, 80, neardup.banded, neardup.close_to, neardup._partners), neardup.sketches(docs)), (None, None)):
        if method is None:
            assert {r.component_id for r in ngram_join.join(docs).collect()} == {0}
            continue
        classes = neardup.shared_checkpoint(made.selectExpr("doc_id AS node", "n_shingles", "sketch"))
        keys = method.keys(classes)
        members = keys.join(keys.groupBy("key").count().withColumnRenamed("count", "n").filter("n > 1"), "key").selectExpr("*", "node AS comp")
        pairs = neardup.chosen(members, 0, keys.count()).collect()
        assert len(pairs) == len({r.node for r in pairs}) <= 1500
        assert len({r.head for r in pairs}) < 30


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_components_in_few_and_in_many_tasks(spark, monkeypatch, few):
    from sieveline.llm import components as stars

    monkeypatch.setattr(stars, "FEW", few)
    monkeypatch.setattr(stars, "EACH", 100)
    rng = random.Random(9)
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1100)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(7, 7), (300, 0)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    found = {r.node: r.component for r in stars.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in list(parent)}
