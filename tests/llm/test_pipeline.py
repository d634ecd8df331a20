import base64
import random
from collections import defaultdict

import public_tokenizers as known
import pytest
import tiktoken
from plain import brute, number, plain_draw, plain_language, plain_quality, size, water

import corpus_pipeline as pipeline
from sieveline.llm import language, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(160):
        words = [rng.choice("the of and to in is that it was for on are with as his they be at one have this".split()) + rng.choice(["", "s", "x"]) for _ in range(40)]
        low = i % 5 == 0
        rows.append((i, " ".join(w + "***" if low else w for w in words), "en", f"s{i % 3}", 1))
        labels.append((i, int(not low), 0))
    rows += [(200, rows[1][1], "en", "s9", 1), (201, rows[1][1] + " more", "en", None, None), (202, None, None, None, None), (203, "", None, "s1", 0), (204, "1234", "en", "s1", 4), (1, rows[1][1], "en", "s1", 1)]
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages_match_plain_versions(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for at, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{at}")
        kept = spark.read.parquet(f"{tmp_path}/{at}")
        before, after = ([tuple(r) for r in d.collect()] for d in (docs, kept))
        assert after, name
        if at < 4:
            assert kept.columns == list(pipeline.COLUMNS)
        if at == 0:
            table, net = quality.fit(docs, labels)
            assert sorted(after, key=repr) == sorted((r for r in before if plain_quality(r[1], table, net) >= 0.3), key=repr)
            assert not {i for i, *_ in after} & set(range(0, 160, 5)) and len(after) >= 125
        elif at == 1:
            model = language.fit(docs)
            named = [plain_language(r[1], model) for r in before]
            assert sorted(after, key=repr) == sorted((r for r, (name, score) in zip(before, named, strict=True) if name != "und" and score >= pipeline.SURE), key=repr)
        elif at == 2:
            stay = {r[0] for r in brute([r[:2] for r in before], 5) if r[3]}
            once = {}
            for r in sorted((r for r in before if r[0] in stay), key=repr):
                once.setdefault(r[:2], r)
            assert sorted(after, key=repr) == sorted(once.values(), key=repr)
            assert 1 in stay and not {200, 201} & stay
        elif at == 3:
            by = defaultdict(list)
            for r in before:
                by[r[3]].append(r)
            want, targets = [], water({s: sum(size(r[1]) for r in own) for s, own in by.items()})
            for s, own in by.items():
                whole, drawn, _ = plain_draw({r[0]: size(r[1]) for r in own}, targets[s], {r[0]: number("mix", r[0]) for r in own})
                want += [r for r in own for _ in range((whole + (r[0] in drawn)) if size(r[1]) else 0)]
            assert sorted(after, key=repr) == sorted(want, key=repr)
        else:
            with open(known.path("byte_bpe_multi_50k.tiktoken")) as lines:
                ranks = {base64.b64decode(t): int(n) for t, n in (line.split() for line in lines)}
            library = tiktoken.Encoding("known", pat_str=known.PATTERN, mergeable_ranks=ranks, special_tokens={})
            want = sorted((r[0], library.encode_ordinary(r[1] or "")) for r in before)
            assert sorted((r.doc_id, list(r.ids)) for r in kept.collect()) == want
        docs = kept


def test_run(spark, folder):
    assert pipeline.ORACLE_SQL is None
    assert pipeline.run(spark, folder).count() > 100


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
