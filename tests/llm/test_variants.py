import random
import re
import zlib
from collections import Counter

import pytest

from sieveline.llm import variants


def plain(rows):
    """The same result by comparing all pairs of words."""
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found, forms = {w: [o for o in words if near(w, o)] for w in words}, {}
    for w, others in found.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        forms[w] = best if best and words[best] >= 5 * words[w] else None

    def root(w):
        return w if forms[w] is None else root(forms[w])

    return sorted((w, forms[w] or "", root(w), k, len(found[w]), words.get(forms[w]) or 0) for w, k in words.items())


def corpus(seed, letters="abcdeé÷Ö", size=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 10))) for _ in range(size)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = base[min(int(rng.expovariate(0.1)), size - 1)]
            if rng.random() < 0.3:  # a slip of some kind
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("ab") + w[at:], w[:at] + rng.choice("ab") + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "1", "¿"]).join(words)))
    return rows + [(1, rows[1][1]), (None, rows[2][1]), (500, None), (501, ""), (502, "āĀ 12"), (503, "lonely " * 7), (504, "aaaaaaa " * 9 + "aaaaaa " * 45)]


@pytest.mark.parametrize("chunk", [2, 64])
@pytest.mark.parametrize("rows", [corpus(1), corpus(2, "ab", 40), [(1, "abcdef " * 4)], [(i, "abcdef abcdeg " * 5) for i in range(9)], []])
def test_matches_all_pairs(spark, monkeypatch, rows, chunk):
    monkeypatch.setattr(variants, "CHUNK", chunk)
    docs = spark.createDataFrame([(i, t, "w", 1, "x") for i, t in rows], "doc_id long, text string, word string, n int, letters string")
    found = [(r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in variants.variants(docs).collect()]
    assert sorted(found) == plain(rows)


def test_a_long_text_is_read_whole(spark):
    rows = [(1, "spelling " * 200_000 + "speling " * 7), (2, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in variants.variants(docs).collect()) == plain(rows)


def test_no_side_of_a_join_is_broadcast(spark, monkeypatch):
    """All joins are between tables that grow with the vocabulary, whatever size Spark takes them for."""
    plans, keep = [], variants.Tables.keep
    monkeypatch.setattr(variants.Tables, "keep", lambda own, name, df: plans.append(df) or keep(own, name, df))
    plans.append(variants.variants(spark.createDataFrame([(1, "spelling " * 50 + "speling " * 7)], "doc_id long, text string")))
    joins = [line for df in plans for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if re.search(r"\bJoin ", line)]
    assert len(joins) >= 5 and all("strategy=merge" in line for line in joins), joins
