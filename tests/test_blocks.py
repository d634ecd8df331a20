import numpy as np
import pytest

from sieveline.functions import image_kernels as kernels
from sieveline.functions.image_bytes import ZIGZAG
from sieveline.operators import blocks


def picture(seed, h, w, step=0):
    """Noise on a slope; with a step, blocks whose coefficients are its multiples, but for a corner."""
    rng = np.random.default_rng(seed)
    plane = np.clip(np.add.outer(np.arange(h), np.arange(w)) % 97 + 70 + rng.normal(0, 12, (h, w)), 0, 255)
    if step:
        d = kernels.block_dct(plane)
        kept = np.rint(d / step) * step
        kept[-1:, -2:] = d[-1:, -2:]
        back = np.einsum("ui,hwuv,vj->hwij", kernels.DCT, kept, kernels.DCT) + 128
        plane = np.clip(back.transpose(0, 2, 1, 3).reshape(h // 8 * 8, w // 8 * 8), 0, 255)
    return np.repeat(np.rint(plane).astype(np.uint8)[..., None], 3, 2)


IMAGES = {"noise": picture(1, 64, 96), "steps": picture(2, 80, 72, 12), "odd": picture(3, 35, 61, 7), "one": picture(4, 8, 8), "flat": np.full((16, 24, 3), 128, np.uint8), "dark": np.zeros((8, 16, 3), np.uint8), "small": picture(5, 7, 90), None: picture(6, 24, 24)}


@pytest.fixture(scope="module")
def rows(spark):
    made = [(k, x.shape[0], x.shape[1], x.tobytes()) for k, x in IMAGES.items()] + [("none", None, None, None), ("cut", 8, 8, b"123")]
    df = blocks.transformed(blocks.image_blocks(spark.createDataFrame(made, "name string, height int, width int, rgb binary").repartition(3), ["name"]))
    return df.persist()


def dct(x):
    return np.round(kernels.block_dct(kernels.grey(x)), blocks.CLEAN)


def whole_images():
    return {k: x for k, x in IMAGES.items() if min(x.shape[:2]) >= 8}


def test_blocks_and_coefficients(rows):
    found = {(r.name, r.block_row, r.block_column): (list(r.c), r.whole) for r in rows.collect()}
    want = {}
    for name, x in whole_images().items():
        d, keep = np.rint(dct(x)).astype(int), kernels.unclipped(kernels.grey(x))
        want |= {(name, i, j): (d[i, j].ravel().tolist(), bool(keep[i, j])) for i in range(d.shape[0]) for j in range(d.shape[1])}
    assert found == want


def test_histograms_match_the_kernels(rows):
    counts = blocks.counted(rows, ["name"])
    steps, sacs = {}, {r.name: r.sac for r in blocks.sac(counts, ["name"]).collect()}
    for r in blocks.primary_steps(counts, ["name"]).collect():
        steps[r.name, r.k] = r.step
    for name, x in whole_images().items():
        table = kernels.primary_table(dct(x), kernels.unclipped(kernels.grey(x))).ravel()
        assert [steps[name, k] for k in range(64)] == table.tolist(), name
        assert sacs[name] == pytest.approx(kernels.sac(dct(x)), abs=1e-12), name
    assert {n for n, _ in steps} == set(sacs) == set(whole_images())
    assert steps["steps", 1] == 12


def test_changed_blocks_match_the_kernel(rows):
    found = blocks.periods(blocks.counted(rows, ["name"]), ["name"])
    spacing = {(r.name, r.k): r.period for r in found.collect()}
    changed = {(r.name, r.block_row, r.block_column): r.changed for r in blocks.changed_blocks(rows, found, ["name"], ["block_row", "block_column"]).collect()}
    for name, x in whole_images().items():
        likely, periods = kernels.tamper_map(dct(x))
        assert [spacing[name, k] for k in ZIGZAG[: blocks.FIRST]] == periods, name
        for i in range(likely.shape[0]):
            for j in range(likely.shape[1]):
                assert changed[name, i, j] == pytest.approx(likely[i, j], abs=1e-9)
    assert len(changed) == rows.count()
    assert max(spacing["steps", k] for k in ZIGZAG[1:4]) > 1


def test_blocks_of_other_sizes_and_none(spark):
    df = spark.createDataFrame([(1, [1] * 63), (2, None), (3, [5] * 64)], "id int, values array<int>")
    assert [(r.id, r.c[0], sum(map(abs, r.c[1:])), r.whole) for r in blocks.transformed(df).collect()] == [(3, -984, 0, True)]
    assert blocks.primary_steps(blocks.counted(blocks.transformed(df.limit(0)), ["id"]), ["id"]).count() == 0
