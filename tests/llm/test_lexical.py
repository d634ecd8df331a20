import math
import random
import re
from collections import Counter

import pytest

from sieveline.llm import lexical


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(items, docs, k=20):
    """Every document scored for every item."""
    own = [(i, Counter(split(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in own:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in Counter(split(text)).items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, docs=150, items=9):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(160)] + ["É", "naïve", "x²", "中文", "I"]
    draw = lambda n: [words[min(int(rng.expovariate(0.03)), len(words) - 1)] for _ in range(n)]
    rows = [(i, rng.choice([" ", ", ", "_"]).join(draw(rng.choice([1, 5, 40, 200])))) for i in range(docs)]
    asked = [(i, " ".join(draw(rng.choice([1, 3, 20, 300])))) for i in range(items)]
    rows += [(docs + i, t) for i, (_, t) in enumerate(asked)] + [(docs + 50, rows[3][1].upper()), (3, rows[3][1]), (None, rows[4][1]), (900, None), (901, "")]
    return asked + [(50, None), (51, "--"), (52, "nobody has this"), (53, "w0 w0 W0"), (54, "All of it")], rows


@pytest.mark.parametrize("sizes", [(4096, 4096, 64, 20), (2, 16, 3, 5), (3, 40, 1, 1)])
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_scoring_everything(spark, monkeypatch, seed, sizes):
    for name, value in zip(("ITEMS", "RUN", "STEP"), sizes, strict=False):
        monkeypatch.setattr(lexical, name, value)
    items, docs = corpus(seed)
    asked = spark.createDataFrame([(i, t, 1.5, "d") for i, t in items], "item_id long, text string, score double, doc_id string")
    rows = spark.createDataFrame([(i, t, "r", 1) for i, t in docs], "doc_id long, text string, rank string, item_id int")
    found = sorted((tuple(r) for r in lexical.search(asked, rows, sizes[3]).collect()), key=repr)
    assert found == plain(items, docs, sizes[3])


@pytest.mark.parametrize("items, docs", [([], [(1, "a b")]), ([(1, "a b")], []), ([(1, "a"), (2, None)], [(1, None), (2, "-")]), ([("x", "a " * 3), ("y", "b")], [(1, "a " * 300_000), (2, "a b"), (5, "a b"), (4, "a b")])])
def test_small_cases(spark, items, docs):
    kind = "string" if items and isinstance(items[0][0], str) else "long"
    found = lexical.search(spark.createDataFrame(items, f"item_id {kind}, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(items, docs)
