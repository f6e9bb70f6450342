"""Kernels and plans against plain versions, known signals and properties."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewise.operators import dsp, pixels, plan, seq, shares


def plain_biquad(x, b, a):
    y = []
    x1 = x2 = y1 = y2 = 0.0
    for v in x:
        w = b[0] * v + b[1] * x1 + b[2] * x2 - a[1] * y1 - a[2] * y2
        x1, x2, y1, y2 = v, x1, w, y1
        y.append(w)
    return np.array(y)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 1000])
def test_biquad_is_the_recursion(n):
    x = np.random.default_rng(n).normal(size=n)
    for b, a in (dsp.shelf(48000), dsp.high_pass(48000)):
        assert np.allclose(dsp.biquad(x, b, a), plain_biquad(x, b, a), atol=1e-9)


def test_k_weighting_of_a_tone():
    t = np.arange(96000) / 48000
    e = (dsp.k_weighted(np.sin(2 * math.pi * 997 * t))[48000:] ** 2).mean()
    assert abs(-0.691 + 10 * math.log10(e) + 3.01) < 0.05


def test_true_peak_between_samples():
    x = np.sin(math.pi / 2 * np.arange(4000) + math.pi / 4)
    assert abs(np.abs(x).max() - math.sqrt(0.5)) < 1e-6
    assert abs(dsp.true_peak_db(x)) < 0.6
    assert dsp.true_peak_db(np.zeros(0)) == dsp.true_peak_db(np.zeros(9)) == -120.0


def test_pixel_kernels():
    rng = np.random.default_rng(1)
    flat, noise = np.full((2, 16, 16), 80.0), rng.integers(0, 256, (3, 16, 16)).astype(float)
    assert (pixels.spatial_info(flat) == 0).all() and (pixels.grain_sigma(flat) == 0).all() and (pixels.temporal_info(flat, flat) == 0).all()
    grainy = 100 + rng.normal(0, 5, (4, 200, 200))
    assert np.allclose(pixels.grain_sigma(grainy), 5, rtol=0.05)
    assert (pixels.motion(np.roll(noise, (1, 2), (1, 2)), noise, 3) == (2, 1)).all() and (pixels.motion(flat, flat, 2) == 0).all()
    boxed = np.zeros((2, 8, 8))
    boxed[0, 2:5, 3:7] = 200
    assert pixels.content_box(boxed, 16).tolist() == [[3, 2, 7, 5], [0, 0, 0, 0]]
    by_hand = [[[f[y : y + 4, x : x + 4].mean() for x in (0, 4, 8, 12)] for y in (0, 4, 8, 12)] for f in noise]
    assert np.allclose(pixels.downscale(noise, 4), by_hand)


def test_mapped_frames_skip_what_is_no_frame(spark):
    rows = [(1, 0, [1.0] * 9, None), (1, 1, [2.0] * 9, [1.0] * 9), (1, 2, None, None), (1, 3, [1.0] * 10, None), (1, 4, [], None)]
    d = spark.createDataFrame(rows, "video_id long, pos long, luma array<double>, before array<double>")
    got = pixels.mapped(d, 3, "ti double", lambda f, p: {"ti": pixels.temporal_info(f, p)}).collect()
    assert sorted(r.pos for r in got) == [0, 1]
    assert pixels.mapped(d.limit(0), 3, "ti double", lambda f, p: {"ti": pixels.temporal_info(f, p)}).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300)), st.integers(1, 300), st.integers(1, 40), st.integers(1, 8))
def test_strata_hold_two_clips(keys, n, target, clip):
    first = plan.gop_strata(keys, n, target, clip)
    last = [*first[1:], n]
    assert first[0] == 0 and first == sorted(set(first))
    assert len(first) == 1 or all(b - a >= 2 * clip for a, b in zip(first[1:], last[1:]))
    scene = plan.scene_strata(keys, n, clip)
    assert scene[0] == 0 and set(scene[1:]) <= set(keys)
    assert len(scene) == 1 or all(b - a >= clip for a, b in zip(scene, [*scene[1:], n]))


def test_strata_by_hand():
    assert plan.gop_strata([10, 20, 30, 100], 110, 15, 2) == [0, 20, 30, 44, 58, 72, 86, 100]
    assert plan.gop_strata([20], 22, 20, 2) == [0]
    assert plan.scene_strata([2, 10, 11, 30], 40, 4) == [0, 11, 30]


def test_take_near(spark):
    rng = random.Random(5)
    rows = [(title, i, rng.randint(1, 60), rng.random()) for title in range(8) for i in range(rng.randint(1, 30))]
    got = plan.take_near(spark.createDataFrame(rows, "title long, id long, length long, s double"), 120, F.col("s")).collect()
    want = set()
    for title in range(8):
        total, n = 0, 0
        for _, i, length, _ in sorted((r for r in rows if r[0] == title), key=lambda r: -r[3]):
            if n == 0 or abs(120 - total - length) < abs(120 - total):
                want.add((title, i))
                total, n = total + length, n + 1
    assert {(r.title, r.id) for r in got} == want


def test_pieces_and_splits(spark):
    rng = random.Random(9)
    rows = [(v, 10 * i, i, rng.random() < 0.3) for v in range(6) for i in range(rng.randint(1, 60))]
    d = spark.createDataFrame(rows, "video_id long, pts long, pos long, key boolean")
    ends = d.groupBy("video_id").agg(F.min("pts").alias("start"), (F.max("pts") + 10).alias("end"))
    got = {(r.video_id, r.piece): (r.start, r.end) for r in seq.pieces(d.where("key").select("video_id", "pts"), ends, 45).collect()}
    split = sorted((r.video_id, r.part, r.first) for r in seq.keyframe_splits(d, 5, 4).collect())
    want, cuts = {}, []
    for v in range(6):
        mine = [r for r in rows if r[0] == v]
        bounds, end = [0], len(mine) * 10
        for r in mine:
            if r[3] and r[1] - bounds[-1] >= 45:
                bounds.append(r[1])
        if len(bounds) > 1 and end - bounds[-1] < 45:
            bounds.pop()
        want |= {(v, i): (a, b) for i, (a, b) in enumerate(zip(bounds, [*bounds[1:], end]))}
        kept, n = [0], len(mine)
        for i in range(1, 5):
            k = next((r[2] for r in mine[i * n // 5 :] if r[3]), n)
            if k - kept[-1] >= 4 and n - k >= 4:
                kept.append(k)
        cuts += [(v, i, k) for i, k in enumerate(kept)]
    assert got == want and split == cuts


def test_collapsed_pair(spark):
    rows = [(1, "a", 0.25, 10.0, 8), (1, "b", 0.75, 14.0, 8), (2, "a", 1.0, 9.0, 4), (3, "a", 0.5, 1.0, 1), (3, "b", 0.5, 3.0, 1)]
    got = shares.collapsed_variance(spark.createDataFrame(rows, "video_id long, stratum string, w double, m double, slots long")).collect()
    mid = (0.25 * 10 + 0.75 * 14) / 1.0
    assert [r.video_id for r in got] == [1] and got[0].df == 1
    assert math.isclose(got[0].variance, 2 * (1 - 1 / 8) * ((0.25 * (10 - mid)) ** 2 + (0.75 * (14 - mid)) ** 2))


def test_digest_is_no_worse_than_its_start(spark):
    rng = random.Random(3)
    rows = [(1, i, rng.random(), rng.random()) for i in range(30)]
    d = spark.createDataFrame(rows, "title long, id long, a double, b double")
    got = sorted((r.slot, r.id) for r in plan.balanced_digest(d, ["a", "b"], 5).collect())
    assert [i // 6 for _, i in got] == [0, 1, 2, 3, 4]
    x = np.array([r[2:] for r in rows])
    x = (x - x.mean(0)) / x.std(0)
    off = lambda ids: (x[list(ids)].mean(0) ** 2).sum()
    chosen = [i for _, i in got]
    assert off(chosen) <= off([3, 9, 15, 21, 27]) + 1e-9
    assert all(off(chosen) <= off(chosen[:k] + [j] + chosen[k + 1 :]) + 1e-9 for k in range(5) for j in range(6 * k, 6 * k + 6))
