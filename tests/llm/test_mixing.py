import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plain import number, plain_draw, size, water

from sieveline.llm import mixing


def rows(n=400):
    out = []
    for i in range(n):
        source = ["a", "b", "é", None, "hot"][min(i % 9, 4)]
        out.append((i, " ".join(["word"] * (i * 37 % 50 + (500 if i == 40 else 0))), source, "x", 1))
    return [*out, (500, None, "empty"), (501, "", "empty"), (502, "\u00a0 \x1c x", "a")]


@pytest.fixture(scope="module")
def mixed(spark):
    docs = spark.createDataFrame([r[:3] + ("clash", 7, 1.0) for r in rows()], "doc_id long, text string, source string, size string, rank int, target double")
    return docs, [r.asDict() for r in mixing.mix(docs).collect()]


def test_targets_and_sizes(mixed):
    _, found = mixed
    sizes = defaultdict(int)
    for i, text, source, *_ in rows():
        sizes[source] += size(text)
    want = water(sizes)
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
    assert {r["doc_id"]: r["size"] for r in found} == {i: size(t) for i, t, *_ in rows()}


def test_takes_come_near_and_never_pass_three_times(mixed):
    _, found = mixed
    taken, target, least = defaultdict(int), {}, defaultdict(lambda: 10**9)
    for r in found:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        least[r["source"]] = min(least[r["source"]], r["size"] or 10**9)
    for s in taken:
        assert abs(target[s] - taken[s]) <= max(0.005 * target[s], least[s] / 2 + 1)


def test_pareto_draw_matches_a_plain_one(mixed):
    _, found = mixed
    by = defaultdict(list)
    for r in found:
        by[r["source"]].append(r)
    by_number = 0
    for own in by.values():
        sizes, u = {r["doc_id"]: r["size"] for r in own}, {r["doc_id"]: number("mix", r["doc_id"]) for r in own}
        whole, drawn, p = plain_draw(sizes, own[0]["target"], u)
        assert {r["doc_id"]: r["copies"] for r in own} == {i: whole + (i in drawn) if sizes[i] else 0 for i in sizes}
        unsure = [i for i in sizes if 0 < p[i] < 1]
        by_number += set(sorted(unsure, key=u.get)[: len(drawn)]) != drawn & set(unsure)
    assert by_number  # the random number alone would draw others


def test_inclusion_frequencies_follow_the_probabilities():
    rng = random.Random(3)
    sizes = {i: int(10 * rng.paretovariate(1.3)) for i in range(300)}
    target, runs, seen = 0.35 * sum(sizes.values()), 200, defaultdict(int)
    for seed in range(runs):
        _, drawn, p = plain_draw(sizes, target, {i: number(seed, i) for i in sizes})
        assert abs(sum(sizes[i] for i in drawn) - target) <= 0.01 * target
        for i in drawn:
            seen[i] += 1
    assert min(p.values()) < 0.2 and max(p.values()) == 1.0
    assert all(seen[i] == runs for i in sizes if p[i] == 1.0)
    for low in (0.0, 0.2, 0.4, 0.6, 0.8):
        group = [i for i in sizes if low < p[i] <= low + 0.2 and p[i] < 1]
        if len(group) > 3:
            got, want = sum(seen[i] for i in group) / runs / len(group), sum(p[i] for i in group) / len(group)
            assert abs(got - want) < 0.05
    assert np.corrcoef([seen[i] / runs for i in sizes], [p[i] for i in sizes])[0, 1] > 0.97


def test_nearest_document_is_taken(spark):
    """Seven documents of a thousand words, and a target of 3,983: four are nearer than three."""
    rows = [(i, "w " * 1000, "a") for i in range(7)] + [(100 + i, "w " * 4966, "b") for i in range(1)]
    found = [r.asDict() for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    target = next(r["target"] for r in found if r["source"] == "a")
    assert 3500 < target < 4000 and sum(r["taken"] for r in found if r["source"] == "a") == 4000


@pytest.mark.parametrize("few", [True, False])
def test_huge_documents_and_many_sources(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "SOURCES", 100 if few else 2)
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 60), f"s{i % 7}") for i in range(400)] + [(500 + i, "w " * 9000, f"s{i}") for i in range(3)]
    found = [r.asDict() for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    assert len(found) == len(rows)
    for s in {r["source"] for r in found}:
        own = [r for r in found if r["source"] == s]
        whole, drawn, _ = plain_draw({r["doc_id"]: r["size"] for r in own}, own[0]["target"], {r["doc_id"]: number("mix", r["doc_id"]) for r in own})
        assert {r["doc_id"]: r["copies"] for r in own} == {r["doc_id"]: whole + (r["doc_id"] in drawn) for r in own}


def test_reruns_agree(mixed):
    docs, found = mixed
    again = [r.asDict() for r in mixing.mix(docs.repartition(5)).collect()]
    assert sorted(again, key=lambda r: r["doc_id"]) == sorted(found, key=lambda r: r["doc_id"])


def test_copies_keep_all_columns_and_repeated_rows(spark):
    rows = [(1, "a b c", "s", 1, {"k": 1}), (1, "a b c", "s", 2, None), (None, "d e", "s", 3, {}), (2, "f " * 30, "t", 4, {}), (3, None, "t", 5, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, rounds map<string,int>")
    drawn = mixing.mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()
    made = mixing.copies(docs)
    assert made.columns == docs.columns
    counted = {r.doc_id: r.n for r in made.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counted == {r.doc_id: r.n for r in drawn if r.n}


def test_empty_tables(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    only = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(only).collect()] == [0, 0]
