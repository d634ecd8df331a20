"""Golden values and properties of metrics and statistics."""

import math
import random
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions import inference
from sieveline.operators import arrays, comparison, distribution, metrics, ranking

SCHEMA = "event_id long, sample_id long, model string, use_tools boolean, trial int, label string, prediction string, error string, confidence double, latency_seconds double, tool_usage array<string>, tool_details array<struct<tool:string,seconds:double>>, vision_model string"


def make(spark, rows):
    return spark.createDataFrame([(i, i, "m", True, 0, *r, 0.5, 1.0, [], [], None) for i, r in enumerate(rows)], SCHEMA)


def test_published_configuration(spark):
    """tp 98, tn 130, fp 16, fn 10, one error among 500."""
    rows = [("fake", "fake", None)] * 98 + [("real", "real", None)] * 130 + [("real", "fake", None)] * 16 + [("fake", "real", None)] * 10
    rows += [("fake", "uncertain", None)] * 139 + [("real", None, "")] * 106 + [("real", "uncertain", "exception")]
    r = metrics.compute_metrics(make(spark, rows)).first()
    assert (r.total, r.tp, r.tn, r.fp, r.fn, r.error_count, r.abstain_count) == (500, 98, 130, 16, 10, 1, 245)
    assert r.accuracy == pytest.approx(0.456) and r.coverage == pytest.approx(0.508)
    assert r.recall_fake == pytest.approx(98 / 108) and r.fake_catch_rate == pytest.approx(98 / 247)
    assert r.answered == 254 and r.coverage_real == pytest.approx(1 - 106 / 253)


def test_empty_denominators(spark):
    r = metrics.compute_metrics(make(spark, [("fake", "uncertain", None), ("other", "uncertain", "x")])).first()
    assert (r.accuracy, r.precision_fake, r.f1_real, r.coverage_real, r.accuracy_answered) == (0, 0, 0, 0, 0)
    assert metrics.compute_metrics(make(spark, [])).count() == 0


@pytest.mark.parametrize(("n10", "n01"), [(238, 9), (26, 29), (0, 0), (1, 0), (700, 600), (5, 5)])
def test_mcnemar(spark, n10, n01):
    b, k = n10 + n01, min(n10, n01)
    want = min(1.0, float(2 * Fraction(sum(comb(b, i) for i in range(k + 1)), 2**b))) if b else 1.0
    p, q = spark.range(1).select(inference.mcnemar_exact(F.lit(n10), F.lit(n01)), inference.mcnemar_exact(F.lit(n01), F.lit(n10))).first()
    assert p == pytest.approx(want, rel=1e-9) and p == q


def test_scalar_statistics(spark):
    low, high = inference.wilson(F.lit(0.914), F.lit(500))
    h, name = inference.cohens_h(F.lit(0.9), F.lit(0.5))
    zero = inference.wilson(F.lit(0.0), F.lit(0))
    r = spark.range(1).select(low, high, h, name, inference.normal_cdf(F.lit(1.96)), zero[0], inference.mcc(*map(F.lit, (5, 5, 0, 0))), inference.mcc(*map(F.lit, (5, 0, 0, 0)))).first()
    assert r[0] == pytest.approx(0.8862, abs=1e-4) and r[1] == pytest.approx(0.9356, abs=1e-4)
    assert r[2] == pytest.approx(0.9273, abs=1e-4) and r[3] == "Large"
    assert r[4] == pytest.approx(0.9750021) and r[5:] == (0.0, 1.0, 0.0)


def test_calibration_by_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        conf = rng.choice([0.0, 0.1, 0.3, 0.6, 0.7, 1.0, rng.random(), 1.7])
        rows.append((i, i, "m", True, 0, rng.choice(["fake", "real"]), rng.choice(["fake", "real", "uncertain", None]), rng.choice([None, "", "x"]), conf, 1.0, [], [], None))
    df = spark.createDataFrame(rows, SCHEMA)
    used = [(min(max(r[8], 0), 1), int(r[5] == r[6]), r[0], r[5], r[6]) for r in rows if not r[7] and r[6] in ("fake", "real")]
    edges = np.linspace(0, 1, 11)
    ece = 0.0
    for i in range(10):
        own = [u for u in used if edges[i] <= u[0] and (u[0] < edges[i + 1] or (i == 9 and u[0] <= 1))]
        if own:
            ece += len(own) / len(used) * abs(np.mean([u[1] for u in own]) - np.mean([u[0] for u in own]))
    assert distribution.ece(df).first().ece == pytest.approx(ece)
    order = sorted(used, key=lambda u: (-u[0], u[2]))
    n, right, area, last = len(order), np.cumsum([u[1] for u in order]), 0.0, 0.0
    for m in range(1, n + 1):
        risk = 1 - right[m - 1] / m
        area += (risk + (last if m > 1 else risk)) / 2 / n if m > 1 else 0
        last = risk
    closed = (sum(1 - right[m - 1] / m for m in range(1, n)) + (1 - right[-1] / n) / 2) / n
    assert distribution.aurc(df).first().aurc == pytest.approx(closed)
    p = [min(max(u[0] if u[4] == "fake" else 1 - u[0], 1e-6), 1 - 1e-6) for u in used]
    y = [int(u[3] == "fake") for u in used]
    r = distribution.brier_and_logloss(df).first()
    assert r.brier == pytest.approx(np.mean([(a - b) ** 2 for a, b in zip(p, y, strict=True)]))
    assert r.logloss == pytest.approx(np.mean([-(b * math.log(a) + (1 - b) * math.log(1 - a)) for a, b in zip(p, y, strict=True)]))


def test_tool_complement(spark):
    rows = [(i, i, "m", True, 0, "fake", ["fake", "real", "uncertain"][i % 3], None, i / 10, 1.0, ["a", "a"] if i % 2 else ["b"], [], None) for i in range(9)]
    found = {r.tool: r for r in metrics.tool_conditional(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (found["a"].used_n_total, found["a"].not_used_n_total) == (4, 5)
    own, rest = [r for r in rows if r[0] % 2], [r for r in rows if not r[0] % 2]

    def acc(part):
        said = [r for r in part if r[6] != "uncertain"]
        return sum(r[6] == "fake" for r in said) / len(said)

    assert found["a"].delta_accuracy_answered == pytest.approx(acc(own) - acc(rest))


@pytest.mark.parametrize(("draw", "low", "high", "name"), [("normal", 0.25, 0.40, "high_variance"), ("two", 0.6, 1.01, "bimodal"), ("uniform", 0.5, 0.6, "possibly_bimodal")])
def test_bimodality_bounds(spark, draw, low, high, name):
    rng = np.random.default_rng(42)
    values = {"normal": rng.normal(0, 1, 4000), "two": rng.choice([-1.0, 1.0], 4000), "uniform": rng.random(4000)}[draw]
    r = arrays.bimodality(spark.createDataFrame([(1, float(v)) for v in values], "g int, v double"), ["g"], "v").first()
    assert low < r.bc < high and r.distribution == name


def test_bimodality_small_and_constant(spark):
    rows = [("few", float(i)) for i in range(9)] + [("same", 1.0)] * 20 + [("few", float("nan"))]
    found = {r.g: r.distribution for r in arrays.bimodality(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert found == {"few": "insufficient_data", "same": "constant"}


def test_next_open_and_numbering(spark):
    df = spark.createDataFrame([(i, i in (1, 2, 5)) for i in range(6)], "i int, done boolean").withColumn("g", F.lit(1))
    assert [r.next_open for r in ranking.next_open(df, ["g"], "i", "done").orderBy("i").collect()] == [3, 3, 3, 4, 0, 0]
    names = ranking.numbered(spark.range(1000).repartition(7), [F.desc("id")], "n%04d", "name").orderBy("name").collect()
    assert [r.id for r in names] == list(range(999, -1, -1)) and names[0].name == "n0001"


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, at int")
    assert {(r.k, r.v) for r in comparison.upserted(old, new, ["k"], "at").collect()} == {(1, "a"), (2, "d"), (3, "e")}


def test_orders_of_a_group_run_over_many_ranges(spark):
    """Running sums, percentiles and next open rows of one group that lies in several ranges, with ties and a null group."""
    import random

    rng = random.Random(3)
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else "b", i, rng.choice([0.1, 0.5, 0.9, rng.random(), None]), rng.random() < 0.9, rng.randrange(5)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, i long, v double, done boolean, w int")
    found = ranking.placed(df, ["g"], [F.col("v").desc(), F.col("i")], {"m": "w"}, "m").collect()
    assert len(found) == 900
    nexts = {r.i: r.next_open for r in ranking.next_open(df, ["g"], "i", "done").collect()}
    ps = {(r.g, r.p): r.value for r in distribution.exact_percentiles(df, ["g"], "v", (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    ends = {(r.g, r.i): (r.from_top, r.from_bottom) for r in ranking.top_and_bottom(df.filter("v IS NOT NULL AND g IS NOT NULL"), ["g"], "v", "i", 4).collect()}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        total, upto = sum(r[4] for r in own), {}
        for r in sorted(own, key=lambda r: (r[2] is None, -(r[2] or 0), r[1])):
            upto[r[1]] = sum(upto.values() and [max(upto.values())]) + r[4]
        assert {r.i: (r.m, r.all_m) for r in found if r.g == g} == {i: (m, total) for i, m in upto.items()}
        left = [r[1] for r in own if not r[3]]
        for r in own:
            assert nexts[r[1]] == min([i for i in left if i > r[1]], default=min(left, default=None))
        values = sorted(r[2] for r in own if r[2] is not None)
        for p in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert ps[g, p] == pytest.approx(float(np.quantile(values, p)))
        if g is not None:
            up = sorted((r for r in own if r[2] is not None), key=lambda r: (-r[2], r[1]))
            down = sorted((r for r in own if r[2] is not None), key=lambda r: (r[2], r[1]))
            for place, r in enumerate(up[:4]):
                assert ends[g, r[1]][0] == place + 1
            for place, r in enumerate(down[:4]):
                assert ends[g, r[1]][1] == place + 1
            place = {r[1]: (up.index(r) + 1, down.index(r) + 1) for r in own if r[2] is not None}
            assert all(v == place[i] for (h, i), v in ends.items() if h == g)
            assert sum(1 for k in ends if k[0] == g) == len({r[1] for r in up[:4]} | {r[1] for r in down[:4]})


def test_mcc_trace_has_every_digit(spark):
    """The product under the root is beyond what a double or a long can hold exactly."""
    counts = (57961, 59461, 57487, 61867)
    tp, tn, fp, fn = counts
    said = spark.range(1).select(inference.mcc_trace(*(F.lit(n).cast("long") for n in counts)).alias("t")).first().t
    assert f" / sqrt[{(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)}]" in said
