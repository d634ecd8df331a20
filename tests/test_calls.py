import json
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions import image_kernels as kernels
from sieveline.functions.text import canonical_json
from sieveline.operators import arrays, calls, distribution


def parts(spark, rows):
    image, params = calls.call_parts(F.col("form"), F.col("call"))
    df = spark.createDataFrame(rows, "form string, call string").select(image.alias("image"), params.alias("params"))
    return [tuple(r) for r in df.collect()]


def test_calls_of_every_form(spark):
    call = lambda *args, **kwargs: json.dumps({"args": args, "kwargs": kwargs})
    code = "image_path = 'a.png'; run(1)"
    rows = [
        ("string", call("a.png")), ("string", call("a.png", 5, x=1)), ("json", call(json.dumps({"path": "a.png", "q": [1, {"b": 2.0, "a": None}]}))), ("json", call({"image_path": "a.png"})),
        ("json", call("a.png")), ("json", call("[1]")), ("structured", call("a.png", 75)), ("structured", call(path="a.png", quality=75.0)), ("structured", call(image_path="a.png")),
        ("structured", call("a.png", 75, quality=3, z="é")), ("code", call(code)), ("code", call(code=code, image_path="b.png")), ("code", call("run(2)", image_path="a.png")), ("code", call("no image")),
        ("string", "no json"), ("string", None), ("json", call()), ("other", call("a.png")), (None, call("a.png")), ("structured", call()),
    ]
    digest = lambda text: '{"code":"' + __import__("hashlib").sha256(text.encode()).hexdigest() + '"}'
    assert parts(spark, rows) == [
        ("a.png", None), ("a.png", None), ("a.png", '{"q":[1,{"a":null,"b":2}]}'), ("a.png", None),
        ("a.png", None), ("[1]", None), ("a.png", '{"quality":75}'), ("a.png", '{"quality":75}'), ("a.png", None),
        ("a.png", '{"quality":75,"z":"é"}'), ("a.png", digest(code)), ("b.png", digest(code)), ("a.png", digest("run(2)")), (None, None),
        (None, None), (None, None), (None, None), (None, None), (None, None), (None, None),
    ]


def test_equal_calls_have_equal_keys_and_programs_differ(spark):
    same = [("json", json.dumps({"args": [text]})) for text in ('{"path":"p","a":{"x":1,"y":[2.50]}}', '{ "a" : {"y": [2.5], "x": 1.0}, "path": "p" }', '{"a":{"y":[25e-1],"x":1e0},"image_path":"p"}', '{"path":"p","a":{"x":1,"y":[2.5]}}')]
    assert len(set(parts(spark, same))) == 1
    programs = [("code", json.dumps({"args": [f"image_path='p'; f({i})"]})) for i in range(3)]
    key = calls.call_key(F.lit("t"), F.lit("h"), F.col("params"))
    found = spark.createDataFrame(parts(spark, programs + programs[:1]), "image string, params string").select("image", key.alias("key")).collect()
    assert {r.image for r in found} == {"p"} and len({r.key for r in found}) == 3
    # without parameters a key is that of the simpler form
    from sieveline.functions.text import cache_key

    one = spark.range(1).select(calls.call_key(F.lit("t"), F.lit("h"), F.lit(None).cast("string")).alias("a"), cache_key(F.lit("t"), F.lit("h"), F.lit(None).cast("map<string,string>")).alias("b")).first()
    assert one.a == one.b


def test_canonical_json(spark):
    rows = ['{"b":"1.0, 2.0","a":[1.0,-3.0,1e2,1.5e-7,10.0]}', '{"k":"say \\"5.0\\" \\\\","j":2.0}', "", None, "{", '{"a":1}{', "null", '"' + "x1.0 " * 30_000 + '"', "\t7.0 "]
    got = [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string").orderBy("i").select(canonical_json(F.col("c"))).collect()]
    assert got == ['{"a":[1,-3,100,1.5E-7,10],"b":"1.0, 2.0"}', '{"j":2,"k":"say \\"5.0\\" \\\\"}', None, None, None, None, "null", rows[7], "7"]


def client(name, bad, log=None):
    def factory():
        def call(key, text):
            if key in bad:
                raise RuntimeError(f"{name} can't")
            return f"{name}:{text}"

        return call

    return factory


@pytest.mark.parametrize("round_robin", [False, True])
def test_attempts_follow_the_policy(spark, round_robin):
    keys = list(range(24))
    bad = {"a": set(range(0, 24, 2)), "b": set(range(0, 24, 3)), "c": set(range(0, 24, 4))}
    retry = {"a": calls.Retry(2, 100, 2.0, 150), "b": calls.Retry(), "c": calls.Retry(1, 50)}
    clients = [calls.Client(n, client(n, bad[n]), retry[n]) for n in "abc"]
    waited = []
    df = spark.createDataFrame([(k, f"t{k}", "x") for k in keys], "key long, text string, client string")
    attempts, outcomes = calls.attempted(df, "key", ["key", "text"], clients, round_robin, waited.append)
    starts = {r[0]: r[1] for r in df.select("key", calls.first_client(F.col("key"), 3)).collect()} if round_robin else dict.fromkeys(keys, 0)
    want, ends = [], {}
    for k in keys:
        n, answer = 0, None
        for i in range(3):
            c = "abc"[(starts[k] + i) % 3]
            for r in range(retry[c].times + 1):
                if answer is None:
                    n += 1
                    ok = k not in bad[c]
                    want.append((k, n, c, r, {0: 0, 1: retry[c].delay_ms, 2: 150}[r], "completed" if ok else "error"))
                    answer = (c, f"{c}:t{k}") if ok else None
        ends[k] = (answer or (None, None), n)
    assert sorted((r.key, r.attempt, r.client, r.retry, r.wait_ms, r.status) for r in attempts.collect()) == sorted(want)
    for r in outcomes.collect():
        (c, text), n = ends[r.key]
        assert (r.client, r.output, r.attempts, r.status) == (c, text, n, "completed" if c else "error") and (r.error is None) == (c is not None)
    assert outcomes.count() == 24 and any(c is None for (c, _), _ in ends.values())
    assert waited and max(waited) == 0.15 and all(w > 0 for w in waited)


def test_attempts_of_nothing_and_of_good_clients(spark):
    good = [calls.Client("a", client("a", set()), calls.Retry(5, 1000))]
    df = spark.createDataFrame([], "key long, text string")
    attempts, outcomes = calls.attempted(df, "key", ["key", "text"], good, sleep=lambda _: pytest.fail("waited"))
    assert attempts.count() == outcomes.count() == 0
    one = calls.attempted(spark.createDataFrame([(1, "x"), (None, "y")], "key long, text string"), "key", ["key", "text"], good, sleep=lambda _: pytest.fail("waited"))[1]
    assert {(r.key, r.attempts, r.status) for r in one.collect()} == {(1, 1, "completed"), (None, 1, "completed")}
    with pytest.raises(ValueError):
        calls.attempted(df, "key", [], [])


@pytest.mark.parametrize("scale", [1, 1000, 1e6])
def test_pooling_matches_the_formula(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(g, float(x * scale), float(w)) for g in "abc" for x, w in zip(rng.normal(size=50), rng.normal(size=50) * 3, strict=True)]
    odd = [("a", None, 1.0), ("a", float("nan"), 1.0), ("a", float("inf"), 1.0), ("a", 1e9 * scale, float("-inf")), ("d", None, 1.0), (None, 2.0, None), (None, 4.0, 0.0)]
    df = spark.createDataFrame(rows + odd, "g string, x double, w double")
    groups = defaultdict(list)
    for g, x, w in [*rows, (None, 2.0, 0.0), (None, 4.0, 0.0)]:
        groups[g].append((x, w))

    def lse(v):
        return float(np.log(np.exp(v - v.max()).sum()) + v.max())

    for weighted in (True, False):
        found = {r.g: r for r in arrays.weighted_pooling(df.filter("x IS NULL OR x < 1e8 OR isnan(x)"), ["g"], "x", "w" if weighted else None).collect()}
        assert set(found) == set(groups)
        for g, own in groups.items():
            x, w = (np.array(v) for v in zip(*own, strict=True))
            w = w if weighted else np.zeros(len(w))
            p = np.exp(w - lse(w))
            want = (-lse(w - lse(w) - x), lse(w - lse(w) + x), (p * x).sum(), (p * x * x).sum())
            got = (found[g].soft_min, found[g].soft_max, found[g].mean, found[g].mean_square)
            assert got == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_fingerprint_of_nulls_and_repeats(spark):
    import hashlib

    rows = [("a", "x"), ("a", None), ("a", "y"), ("a", "x"), (None, "z"), ("b", None), *[("c", f"{i:03}") for i in range(300)]]
    found = {r.g: r for r in distribution.fingerprint(spark.createDataFrame(rows, "g string, k string"), ("g",), "k").collect()}
    digest = lambda ids: hashlib.sha256("\n".join(ids).encode()).hexdigest()[:16]
    assert {g: (r.n, r.n_ids, r.fingerprint, r.first_ids) for g, r in found.items()} == {
        "a": (4, 2, digest(["x", "x", "y"]), "x,x,y"), None: (1, 1, digest(["z"]), "z"), "b": (1, 0, digest([]), ""), "c": (300, 300, digest([f"{i:03}" for i in range(300)]), ",".join(f"{i:03}" for i in range(10))),
    }


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (8, 8), (15, 32), (600, 301)])
def test_cosine_transform_is_the_matrix_product(shape):
    g = np.random.default_rng(1).normal(size=shape)

    def matrix(n):
        k = np.arange(n)
        return np.sqrt(np.where(k == 0, 1, 2) / n)[:, None] * np.cos((2 * k[None] + 1) * k[:, None] * np.pi / (2 * n))

    assert np.abs(kernels.cosine_transform(g) - matrix(shape[0]) @ g @ matrix(shape[1]).T).max() < 1e-9


def test_large_spectra_are_quick():
    g = np.random.default_rng(2).integers(0, 256, (4000, 4000)).astype(np.uint8)
    began = time.process_time()
    found = kernels.cosine_transform(g)
    assert time.process_time() - began < 8 and (found**2).sum() == pytest.approx((g.astype(float) ** 2).sum())
