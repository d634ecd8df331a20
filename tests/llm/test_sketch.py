import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import sketch as S


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: ((r[0] is not None, r[0] or 0), r[1]))
    out = []
    for at, (i, t) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        own, other, nxt = (S.sketch(x) for x in (t, edited, after))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), S.digest(own), S.digest(other), S.likeness(own, other), S.likeness(own, nxt)))
    return out


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@pytest.mark.parametrize(
    "rows",
    [
        [(5, "one two three four five six seven " * 9), (1, None), (3, ""), (2, "é漢😀" * 40), (9, "a"), (4, "one two three four five six seven " * 9)],
        [(7, "alone in the table")],
        [(1, "twice"), (1, "twice"), (None, "no id"), (1, "other"), (2, "x" * 200_000)],
        [],
    ],
)
def test_matches_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, bucket string, guest string")
    got = [tuple(r) for r in S.fingerprints(docs).select(*COLUMNS).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_shingle_hashes_are_of_content_alone():
    text = np.frombuffer("abcdefghijklmnopqrstuvwxyz".encode("utf-32-le"), np.uint32)
    whole = S.shingle_hashes(text, 12)
    assert len(whole) == 15
    for i in range(15):
        assert S.shingle_hashes(text[i : i + 12], 12)[0] == whole[i]
    assert len(set(whole.tolist())) == 15


def test_sketches_merge_and_contain():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(4000)]
    book = " ".join(words)
    passage = " ".join(words[1000:1300])
    a, b = S.sketch(passage), S.sketch(book)
    assert S.containment(a, b) == 1.0
    assert S.likeness(a, b) < 0.12
    left, right = book[: len(book) // 2 + 11], book[len(book) // 2 :]
    assert set(S.merge([S.sketch(left), S.sketch(right)]).tolist()) == set(b.tolist())


@pytest.mark.parametrize("kind", ["string", "decimal(30,0)", "timestamp", "int"])
@pytest.mark.parametrize("span", [1 << 24, 200])
def test_ids_of_any_type(spark, monkeypatch, kind, span):
    monkeypatch.setattr(S, "RANGE_BYTES", span)
    rng = np.random.default_rng(1)
    rows = [(int(i), "".join(rng.choice(list("abcd "), 40))) for i in rng.permutation(90)] + [(None, "none"), (None, None), (17, "again")]
    cast = {"string": "CASE WHEN i < 9 THEN 'd-' || i ELSE 'e' || i END", "timestamp": "timestamp_seconds(i)", "decimal(30,0)": "CAST(i AS decimal(30,0)) + 9007199254740992000", "int": "i"}[kind]
    docs = spark.createDataFrame(rows, "i int, text string").selectExpr(f"{cast} AS doc_id", "text")
    got = [tuple(r) for r in S.fingerprints(docs).select(*COLUMNS).collect()]
    plain = [tuple(r) for r in docs.collect()]
    least = min(i for i, _ in plain if i is not None)
    rows = sorted(plain, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else least, r[1] or ""))
    assert len(got) == len(rows)
    for found in got:
        at = [n for n, r in enumerate(rows) if r[0] == found[0]]
        nexts = {brute_pair(rows[n][1], rows[(n + 1) % len(rows)][1]) for n in at}
        assert tuple(found[1:]) in nexts


def brute_pair(text, after):
    t, after = text or "", after or ""
    h = len(t) // 2
    edited = t[: len(t) - h] + after[:h]
    own, other, nxt = (S.sketch(x) for x in (t, edited, after))
    return len(t), hashlib.sha256(edited.encode()).hexdigest(), S.digest(own), S.digest(other), S.likeness(own, other), S.likeness(own, nxt)


def test_merged_by_group(spark):
    rng = np.random.default_rng(2)
    texts = [(g, "".join(rng.choice(list("abcdefgh"), n))) for g, n in [(1, 400), (1, 13), (2, 14), (2, 13), (3, 0), (3, 0), (4, 5), (5, 900), (5, 2000), (6, 12), (6, 12), (None, 13)]]
    docs = spark.createDataFrame([(i, t or None, g) for i, (g, t) in enumerate(texts)], "doc_id long, text string, g int")
    parts = S.sketches(docs).join(docs.select("doc_id", "g"), "doc_id")
    found = {r.g: list(r.sketch) for r in S.merged(parts, ["g"]).collect()}
    for g in {g for g, _ in texts}:
        assert found[g] == S.merge([S.sketch(t) for h, t in texts if h == g]).view(np.int64).tolist()


def test_rows_without_an_id_or_of_one_id_are_dealt_over_ranges(spark):
    """Many null and equal ids: several ranges share them, each gets one guest, and every row has the right next one."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 30))
    rows = [(None, word()) for _ in range(1500)] + [(7, word()) for _ in range(900)] + [(i, word()) for i in range(20)] + [(None, "same " * 9)] * 300 + [(None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    placed = S.ranged(docs.selectExpr("doc_id", "coalesce(text, '') AS text")).collect()
    own = [r for r in placed if not r.guest]
    buckets = {}
    for r in own:
        buckets.setdefault(r.bucket, []).append((r.doc_id is not None, r.doc_id or 0, r.text))
    guests = [r for r in placed if r.guest]
    assert len(own) == len(rows) and len(guests) == len(buckets) == len({r.bucket for r in guests})
    assert len({r.bucket for r in own if r.doc_id is None}) > 3 and len({r.bucket for r in own if r.doc_id == 7}) > 3
    assert max(map(len, buckets.values())) < len(rows) / 3
    order = sorted(buckets)
    assert all(max(buckets[a]) <= min(buckets[b]) for a, b in zip(order[:-1], order[1:], strict=True))
    for r in guests:
        after = order[(order.index(r.bucket) + 1) % len(order)]
        assert (r.doc_id is not None, r.doc_id or 0, r.text) == min(buckets[after])
    ordered = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + ordered[(n + 1) % len(ordered)][2][: len(t) // 2]).encode()).hexdigest() for n, (_, _, t) in enumerate(ordered))
    assert sorted(r.edited_sha256 for r in S.fingerprints(docs).select("edited_sha256").collect()) == want
