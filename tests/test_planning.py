"""Ladder planning on cases with known answers."""

import math

from framewise.operators import planning


def test_calibration_follows_the_slope_and_the_tolerances(spark):
    probes = spark.createDataFrame([(1, 720, 20.0, 96.0), (1, 720, 25.0, 91.0), (1, 720, 30.0, 81.0), (1, 360, 20.0, 80.0)], "title int, height int, crf double, quality double")
    rungs = spark.createDataFrame(
        [(1, 720, 0, 26.0, True, 90.0, 89.0), (1, 720, 1, 26.0, False, 90.0, 89.0), (1, 720, 2, 40.0, False, 90.0, 80.0), (1, 720, 3, 10.0, False, 90.0, 95.0), (1, 360, 4, 20.0, False, 90.0, 50.0), (1, 720, 5, 26.0, False, 90.0, None)],
        "title int, height int, rung int, crf double, top boolean, predicted double, measured double",
    )
    got = {r.rung: (r.next_crf, r.calibrated) for r in planning.calibrated(rungs, probes, 0.5, 0.0, 51.0).collect()}
    assert got == {0: (25.5, True), 1: (26.0, False), 2: (35.0, True), 3: (15.0, True), 4: (20.0, False), 5: (26.0, False)}


def test_a_higher_curve_challenges_only_where_it_may_win(spark):
    low = [(1, 360, 500, 60.0), (1, 360, 4000, 75.0)]
    good = [(1, 720, 2000, 80.0), (1, 720, 4000, 90.0)]  # drawn on to 1000: 70 > 65
    steep = [(1, 1080, 2500, 72.0), (1, 1080, 2600, 95.0)]  # wins at 2500, drawn on to 1000 far below
    rungs = spark.createDataFrame([(1, 360, 1000), (1, 360, 3000), (1, 720, 1000)], "title int, height int, rate long")
    curve = spark.createDataFrame(low + good + steep, "title int, height int, bitrate long, fitted double")
    got = sorted(tuple(r) for r in planning.challengers(rungs, curve).collect())
    # 1080 is below 720 at 2500, but 720 isn't probed at 1000, so nothing speaks against 1080's start there except its own
    assert (1, 360, 1000, 720) in got and not any(r[0:3] == (1, 360, 3000) for r in got) and (1, 360, 1000, 1080) not in got


def test_pieces_lie_end_to_end_in_the_digest(spark):
    shots = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 100, 50), (1, 2, 150, 50)], "title int, shot int, start long, frames long")
    segments = spark.createDataFrame([(1, 0, 80, 40), (1, 1, 140, 30)], "title int, segment int, start long, frames long")
    got = sorted(tuple(r) for r in planning.digest_pieces(shots, segments, 64).collect())
    assert got == [(1, 0, 0, 0, 20), (1, 0, 1, 20, 20), (1, 1, 1, 40, 10), (1, 1, 2, 50, 20)]


def test_bend_of_a_parabola_and_of_too_few_crfs(spark):
    rows = [(1, 720, c, math.exp(10 - 0.1 * (c - 25) + 0.002 * (c - 25) ** 2), 90 - (c - 25) - 0.05 * (c - 25) ** 2, 22.0, 28.0) for c in (20.0, 23.0, 25.0, 27.0, 30.0, 45.0)]
    rows[-1] = (*rows[-1][:4], 0.0, 22.0, 28.0)  # too far from the range to count
    rows += [(2, 720, 20.0, 1e6, 90.0, 22.0, 28.0), (2, 720, 25.0, 5e5, 80.0, 22.0, 28.0)]
    got = {r.title: r for r in planning.title_bend(spark.createDataFrame(rows, "title int, height int, crf double, rate double, quality double, low double, high double")).collect()}
    assert abs(got[1].rate_bend - 0.002) < 1e-9 and abs(got[1].quality_bend + 0.05) < 1e-9
    assert (got[2].rate_bend, got[2].quality_bend) == (0.0, 0.0)


def test_heights_sets_and_weights(spark):
    t = spark.createDataFrame([(1, 720), (2, 240)], "title int, source int")
    assert sorted((r.title, r.place, r.height) for r in planning.candidate_heights(t, [1080, 720, 720, 360]).collect()) == [(1, 0, 720), (1, 1, 360), (2, 0, 240)]
    names = spark.createDataFrame([("x264_rate",), ("src_q",), ("scale_x",), ("si",)], "name string")
    assert sorted(map(tuple, planning.feature_sets(names).collect())) == [(0, "si"), (0, "src_q"), (0, "x264_rate"), (1, "si"), (1, "x264_rate"), (2, "si"), (2, "src_q"), (3, "si")]
    w = spark.range(1).select(*[planning.luma_weight(F, d).alias(n) for n, F, d in (("a", _lit(0), 10), ("b", _lit(500), 10), ("c", _lit(255), 8))]).first()
    assert (w.a, w.b, w.c) == (0.5, 1.0, 4.0)


def _lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_segments_of_a_clip_are_one(spark):
    seg = spark.createDataFrame([(1, 1, 10, 20, 12), (1, 0, 0, 10, 14), (2, 0, 5, 6, 1)], "clip int, segment int, first int, stop int, decoded int")
    assert sorted(map(tuple, planning.merged_clips(seg).collect())) == [(1, 0, 20, 26), (2, 5, 6, 1)]
    frames = spark.createDataFrame([(1, 1, 0, 3.0), (1, 0, 1, 2.0), (1, 0, 0, 1.0), (1, 1, 1, 4.0)], "clip int, segment int, frame int, score double")
    assert sorted(map(tuple, planning.merged_frames(frames).collect())) == [(1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0), (1, 3, 4.0)]


def test_measurement_keeps_encodes_without_means(spark):
    e = spark.createDataFrame([(1, 90.0), (2, 80.0)], "encode int, quality double")
    m = spark.createDataFrame([(1, "metric", "ssim", 0.9), (1, "metric", "cambi", 2.0)], "encode int, kind string, name string, mean double")
    got = {r.encode: (r.quality, r.metrics, r.devices) for r in planning.measurement(e, m).collect()}
    assert got == {1: (90.0, {"ssim": 0.9, "cambi": 2.0}, None), 2: (80.0, None, None)}
