import base64
import hashlib
import random

import public_tokenizers as known
import pytest
import tiktoken

from sieveline.llm import bpe

PATH = known.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=known.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(PATH, known.PATTERN)


def test_odd_characters(coder, reference):
    rng = random.Random(1)
    letters = "aabAB  \n\t'sé漢字😀̀\x1c\x85 　١2Ⅷ-_!?ſ'\x00<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(2000)]
    assert coder.encode(texts) == [reference.encode_ordinary(t) for t in texts]


def test_long_words_and_overlapping_pairs(coder, reference):
    texts = ["a" * 5001, " " * 3000, "ab" * 4000, "aaab" * 999, "\n" * 500 + "x", "漢" * 2000, ""]
    found = coder.encode(texts)
    assert found == [reference.encode_ordinary(t) for t in texts]
    assert [coder.decode(x).decode() for x in found] == texts


def test_the_store_may_be_full(monkeypatch, reference):
    monkeypatch.setattr(bpe, "KEPT", 3)
    small = bpe.Encoder(PATH, known.PATTERN)
    for text in ("one two three four five", "five six one seven", "one"):
        assert small.encode([text]) == [reference.encode_ordinary(text)]
    assert len(small.known) == 3


def test_query_rows(spark, reference):
    texts = [(1, "Hello, world! é"), (2, None), (3, ""), (3, "again"), (None, "x " * 100_000)]
    docs = spark.createDataFrame([(i, t, 0, "c") for i, t in texts], "doc_id long, text string, n_tokens int, ids string")
    found = bpe.encode(docs, PATH, known.PATTERN, decoded=True).collect()
    want = {(i, t or "") for i, t in texts}
    for r in found:
        ids = reference.encode_ordinary(r.decoded)
        assert (r.doc_id, r.decoded) in want
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert len(found) == len(texts)
    assert bpe.encode(docs.limit(0), PATH, known.PATTERN).count() == 0


def test_workers_collect_garbage_again(spark):
    import gc

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").repartition(4)
    assert bpe.encode(docs, PATH, known.PATTERN).count() == 20

    def collecting(batches):
        for batch in batches:
            batch["id"] = int(gc.isenabled())
            yield batch

    assert {r.id for r in spark.range(64, numPartitions=16).mapInPandas(collecting, "id long").collect()} == {1}
