import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from plain import plain_counts, plain_hash, plain_language, plain_mix, plain_quality, plain_rows

from sieveline.llm import language, quality, toxicity
from sieveline.llm.labels import labelled, once

WORDS = {"en": "the of and to in is that it was for on are with as his they be at one have this".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(), "el": "και το της του να με για από είναι στην που δεν θα στο την αυτό μας".split()}
BAD = ["vrongle", "snorbit", "plugface"]


def fold(key, of):
    return zlib.crc32(b"" if key is None else str(key).encode()) % of


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(900):
        lang = ["en", "de", "el"][i % 3]
        words = [rng.choice(WORDS[lang]) for _ in range(rng.randrange(12, 60))]
        low, bad = rng.random() < 0.3, rng.random() < 0.25
        if bad:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "s", "ing"])
        if low:
            words = [w + rng.choice(["***", "&&&"]) for w in words] if rng.random() < 0.5 else words[:3] * 20
        docs.append((i, " ".join(words), lang if i % 11 else None, "s", len(words)))
        if i % 10 < 7:
            labels.append((i, int(not low), int(bad)))
    docs += [(900, None, "en", "s", 0), (901, "", "de", "s", 0), (902, "12 34 !!", "en", "s", 0), (902, "12 34 !!", "en", "s", 0), (None, "the of and", "en", "s", 0), (903, "the of and to " * 40_000, None, None, 0)]
    return (
        spark.createDataFrame([(*d, 0.5, 7) for d in docs], "doc_id long, text string, lang string, source string, n_chars int, score double, predicted int"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {k: (q, t) for k, q, t in labels}, docs,
    )


@pytest.mark.parametrize(("module", "at", "threshold"), [(quality, 0, 0.3), (toxicity, 1, 0.5)])
def test_held_out_accuracy(made, module, at, threshold):
    docs, labels, truth, rows = made
    found = module.score(docs, labels).collect()
    assert len(found) == len(rows)
    right = []
    for r in found:
        assert r.held_out == (fold(r.doc_id, 5) == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        if r.held_out and r.doc_id in truth:
            right.append(r.predicted == truth[r.doc_id][at])
    assert len(right) > 80 and np.mean(right) > 0.9
    assert len({r.score for r in found if r.doc_id in (900, 901)}) == 1
    again = {(r.doc_id, r.score) for r in module.score(docs.repartition(3), labels).collect()}
    assert again == {(r.doc_id, r.score) for r in found}


@pytest.mark.parametrize("module", [quality, toxicity])
def test_labels_of_the_held_out_fold_and_other_columns_do_not_count(made, spark, module):
    from pyspark.sql import functions as F

    docs, labels, _, _ = made
    flip = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = labels.select("doc_id", *(F.when(flip, 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")))
    changed = docs.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string")})
    assert {tuple(r) for r in module.score(changed, other).collect()} == {tuple(r) for r in module.score(docs, labels).collect()}


@pytest.mark.parametrize("module", [quality, toxicity])
def test_few_labels(made, spark, module):
    docs, labels, _, _ = made
    small = docs.limit(5)
    for some in (labels.limit(0), labels.filter("quality = 1 AND toxic = 0").limit(3)):
        found = module.score(small, some).collect()
        assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    assert module.score(docs.limit(0), labels).count() == 0


def test_quality_keeps_columns(made):
    docs, labels, _, rows = made
    kept = quality.score(docs, labels, keep=True)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "predicted"]
    assert kept.count() == len(rows)


def test_language(made):
    docs, _, _, rows = made
    found = language.predict(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (fold(r.doc_id, 4) == 2)
    named = {(r.doc_id, r.lang_pred, r.score) for r in found}
    assert {(900, "und", 0.0), (901, "und", 0.0), (902, "und", 0.0)} <= named
    truth = {d[0]: ["en", "de", "el"][d[0] % 3] for d in rows if d[0] is not None and d[0] < 900}
    held = [r.lang_pred == truth[r.doc_id] for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean(held) > 0.97


def test_language_learns_from_its_fold_alone(made):
    from pyspark.sql import functions as F

    docs, _, _, _ = made
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    changed = docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    assert {(r.doc_id, r.lang_pred) for r in language.predict(changed).collect()} == {(r.doc_id, r.lang_pred) for r in language.predict(docs).collect()}
    assert {r.lang_pred for r in language.predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.predict(docs.limit(0)).count() == 0


def test_rare_languages_are_learned_from_a_small_sample(made, spark):
    docs, _, _, _ = made
    rng = random.Random(5)
    words = "ja on ei se että hän oli mutta kun niin kuin ovat joka sitä tämä vain olla myös jos".split()
    rare = [(i, " ".join(rng.choices(words, k=30)), "fi", "s", 0, 0.5, 7) for i in range(2000, 2024)]
    rare += [(None, "ja on ei se että hän", "xx", "s", 0, 0.5, 7)]
    both = docs.unionByName(spark.createDataFrame(rare, docs.schema))
    # about 600 learning rows in three languages, of which a uniform sample of 30 has about one in Finnish
    assert set(language.fit(both, 30).names) == {"en", "de", "el", "fi", "xx"}
    found = {r.doc_id: r for r in language.predict(both, 30).filter("doc_id >= 2000").collect()}
    assert len(found) == 24 and any(r.held_out for r in found.values())
    assert {r.lang_pred for r in found.values()} == {"fi"}


def test_sample_is_filled_evenly():
    assert language.level([10, 2000, 3000, 9000], 4000) == 1330
    assert language.level([10, 20], 4000) >= 20
    assert language.level([10**6] * 1000, 4000) == language.LEAST


def test_ftrl_weights_are_sparse():
    rng = np.random.default_rng(0)
    rows, y = [], rng.integers(0, 2, 200)
    for label in y:
        at = np.unique(np.concatenate([rng.integers(10, 2000, 20), [label]]))
        rows.append((at, np.full(len(at), 1 / np.sqrt(len(at)))))
    w, _ = language.train(rows, y, 2)
    assert (w == 0).mean() > 0.9 and w[0, 0] > 0 > w[0, 1]


LONG_WORD = "é" * 900


def test_quality_matches_a_plain_forward_pass(made, spark):
    docs, labels, _, rows = made
    extra = spark.createDataFrame([(5000, f"{LONG_WORD} a {LONG_WORD} 12,34 a", "en", "s", 0, 0.5, 7)], docs.schema)
    docs = docs.unionByName(extra)
    table, net = quality.fit(docs, labels)
    place, sign = quality.marks()
    context, counts = np.zeros((quality.ROWS, quality.WIDTH), np.int64), np.zeros(quality.ROWS, np.int64)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for text in [r[1] for r in rows] + [texts[5000]]:
        own = plain_rows(text)
        for i, row in enumerate(own):
            counts[row] += 1
            for j in (i - 1, i + 1):
                if 0 <= j < len(own):
                    for m in range(quality.MARKS):
                        context[row, place[own[j], m]] += sign[own[j], m]
    assert (quality.vectors(context, counts) == table).all()
    for r in quality.score(docs, labels).collect():
        own = plain_rows(texts[r.doc_id])
        assert r.score == pytest.approx(plain_quality(texts[r.doc_id], table, net), abs=1e-9)
        if r.doc_id == 903:
            assert len(own) == 160_000


def test_toxicity_matches_a_plain_sum(made):
    docs, labels, _, _ = made
    weights, bias = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(docs, labels).collect():
        found = set()
        for word in re.findall(rb"[A-Za-z\x80-\xff]+", (texts[r.doc_id] or "").encode()):
            word = word.lower()
            found.add(plain_hash(word) >> 64 - toxicity.BITS)
            for k in toxicity.BEGINNINGS:
                if len(word) > k:
                    found.add(plain_mix(plain_hash(word[:k]) + k & (1 << 64) - 1) >> 64 - toxicity.BITS)
        z = sum(weights[f] for f in found) + bias
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_language_matches_plain_counts(made):
    docs, _, _, rows = made
    model = language.fit(docs)
    df, n = defaultdict(int), 0
    for key, text, lang, *_ in rows:
        if fold(key, 4) != 2 and lang is not None and text is not None:
            n += 1
            for f in plain_counts(text):
                df[f] += 1
    idf = np.log((n + 1) / (np.array([df[f] for f in range(1 << language.BITS)]) + 1)) + 0.1
    assert np.allclose(model.idf, idf)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in language.predict(docs).collect():
        text = texts[r.doc_id]
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        if len(text) > 10_000 or (r.doc_id or 0) % 5:
            continue
        name, score = plain_language(text, model._replace(idf=idf))
        assert r.lang_pred == name and r.score == pytest.approx(score, abs=1e-9)


def test_ids_that_repeat_count_once(made, spark):
    """Samples are bounded by rows: an id of many rows is one example."""
    docs, labels, _, _ = made
    many = spark.range(3000).selectExpr("1L AS doc_id", "concat('vrongle ', id) AS text", "'en' AS lang", "'s' AS source", "1 AS n_chars", "0.5D AS score", "7 AS predicted")
    both = docs.unionByName(many)
    toxic = labels.filter("doc_id <> 1").unionByName(spark.createDataFrame([(1, 1, 1)] * 5, labels.schema))
    found = labelled(both, toxic, "toxic", 10_000).groupBy("doc_id").count().filter("count > 1").collect()
    assert not found
    assert once(both, both.select("doc_id").filter("doc_id IS NOT NULL").distinct()).count() == docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().count()
    assert toxicity.score(both, toxic).count() == both.count() and quality.score(both, toxic).count() == both.count()


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 3)
    docs = spark.createDataFrame([(i, f"word {i}", f"l{i % 5}") for i in range(60)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 3"):
        language.predict(docs)
    assert language.predict(docs.filter("lang < 'l3'")).count() > 0
