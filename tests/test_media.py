"""Fixtures of the media operators, on tiny tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.functions import scalars as fn
from framewise.functions import stats
from framewise.operators import audio, findings, ladder, seq
from framewise.plans import registry
from framewise.sources import ingest

S = 1_000_000_000
MS40 = 40_000_000


def stream(spark, n, size, gop, change=None):
    rows = [[1, i, i * MS40, MS40, size, i % gop == 0] for i in range(n)]
    for i, v in (change or {}).items():
        rows[i][4] = v
    return spark.createDataFrame(rows, "video_id long, pos long, pts long, dur long, size long, key boolean")


def test_constant_stream(spark):
    p = stream(spark, 100, 1000, 25)
    assert [r.bitrate for r in seq.bitrate_series(p).orderBy("bucket").collect()] == [200_000] * 4
    assert seq.peak_bitrate(p).first().bitrate == 200_000
    g = registry.gops(p).first()
    assert (g.keys, g.mean, g.fixed) == (4, S, True)


def test_spike_and_partial_bucket(spark):
    p = stream(spark, 100, 1000, 25, {60: 26_000})
    best = seq.peak_bitrate(p).first()
    assert best.bitrate == 400_000 and 60 * MS40 - S < best.pts <= 60 * MS40
    assert seq.peak_bitrate(p, 2 * S).first().bitrate == 300_000
    assert [r.bitrate for r in seq.bitrate_series(stream(spark, 30, 1000, 30)).orderBy("bucket").collect()] == [200_000] * 2


def test_single_packet_and_empty(spark):
    one = spark.createDataFrame([(1, 0, 0, 0, 100, True)], "video_id long, pos long, pts long, dur long, size long, key boolean")
    assert [tuple(r) for r in seq.bitrate_series(one).collect()] == [(1, 0, 0, 0)]
    assert seq.bitrate_series(one.where("false")).count() == 0
    assert seq.peak_bitrate(one.where("false")).count() == 0


def test_irregular_gop(spark):
    p = stream(spark, 100, 1000, 1000).withColumn("key", F.col("pos").isin(0, 10, 60, 70))
    g = registry.gops(p).first()
    assert (g.shortest, g.longest, g.fixed) == (10 * MS40, 50 * MS40, False)


@pytest.mark.parametrize("flags,least,want", [("FFFFF", 0, []), ("FTTFF", 2, [(1, 3)]), ("FFFTT", 0, [(3, 5)]), ("TFTTF", 2, [(2, 4)])])
def test_flag_runs(spark, flags, least, want):
    rows = spark.createDataFrame([(1, i, i * S, 5 * S, c == "T") for i, c in enumerate(flags)], "video_id long, pos long, pts long, end long, f boolean")
    got = seq.flag_runs(rows, F.col("f"), least * S).orderBy("start").collect()
    assert [(r.start // S, r.end // S) for r in got] == want


@pytest.mark.parametrize("scores,gap,want", [([0, 40], 10**7, [1]), ([2] * 30 + [40] + [2] * 39 + [35] + [2] * 29, S // 2, [30, 70]), ([30] * 100, S // 2, []), ([0] * 30 + [40, 0, 0, 0, 0, 40] + [0] * 20, S // 2, [30]), ([0] * 50 + [8], S // 2, [])])
def test_scene_cuts(spark, scores, gap, want):
    rows = spark.createDataFrame([(1, i, i * MS40, float(x)) for i, x in enumerate(scores)], "video_id long, pos long, pts long, score double")
    assert [r.pos for r in seq.scene_cuts(rows, min_gap=gap).orderBy("pos").collect()] == want


def test_statistics(spark):
    d = spark.createDataFrame([(1, float(x)) for x in (5, 1, 4, 2, 3)], "k int, v double")
    assert tuple(stats.summarize(d, ["k"], "v").first())[1:] == (3, 1, 5, 1, 3, 5)
    e = spark.createDataFrame([(1, float(x)) for x in range(10, 101, 10)], "k int, v double")
    for p, want in ((0.5, 50), (0.55, 60), (1.0, 100)):
        assert e.agg(stats.nearest_rank("v", p)).first()[0] == want
    assert spark.range(1).select(stats.population_sigma(F.lit(40.0), F.lit(232.0), F.lit(8))).first()[0] == 2
    assert spark.range(1).select(stats.population_sigma(F.lit(3.0), F.lit(2.999), F.lit(3))).first()[0] == 0


def test_student_quantile(spark):
    got = [spark.range(1).select(fn.student_quantile(F.lit(d))).first()[0] for d in (0, 1, 2, 5, 10, 30, 10**9)]
    assert got[0] == math.inf and np.allclose(got[1:], [12.7062, 4.3027, 2.5706, 2.2281, 2.0423, 1.96], atol=5e-3)


def test_estimates(spark):
    clips = spark.createDataFrame([(1, s, float(m), 4) for s, m in ((0, 79), (0, 81), (1, 89), (1, 91))], "video_id int, stratum int, mean double, frames int")
    strata = spark.createDataFrame([(1, 0, 40, 10), (1, 1, 40, 10)], "video_id int, stratum int, frames int, slots int")
    r = stats.pooled_estimate(clips, strata).first()
    assert r["mean"] == 85 and r.half_width > 0
    assert stats.pooled_estimate(clips, strata.withColumn("slots", F.lit(2))).first().half_width == 0
    assert stats.pooled_estimate(clips.where("mean = 79"), strata).first().half_width == math.inf
    v = spark.createDataFrame([(1, s, float(m), 1) for s, m in ((0, 1), (0, 3), (1, 10), (1, 12), (1, 14), (2, 50))], "video_id int, stratum int, mean double, frames int")
    st = spark.createDataFrame([(1, s, 10, 10) for s in range(3)], "video_id int, stratum int, frames int, slots int")
    r = stats.pooled_estimate(v, st).first()
    assert (round(r.variance, 9), r.df) == (round(10 / 3, 9), 3)


def test_coverage_of_the_interval(spark):
    """About 95 % of seeded two-stage draws hold the truth."""
    r = random.Random(4)
    truth = [[r.gauss(80 + 3 * s, 4) for _ in range(40)] for s in range(6)]
    rows = [(v, s, x, 1) for v in range(300) for s in range(6) for x in r.sample(truth[s], 4)]
    clips = spark.createDataFrame(rows, "video_id int, stratum int, mean double, frames int")
    strata = spark.createDataFrame([(v, s, 40, 40) for v in range(300) for s in range(6)], "video_id int, stratum int, frames int, slots int")
    mean = sum(map(sum, truth)) / 240
    got = stats.pooled_estimate(clips, strata).collect()
    assert 0.9 <= sum(abs(x["mean"] - mean) <= x.half_width for x in got) / 300 <= 0.99


def test_isotonic_equals_pooling(spark):
    r = random.Random(1)
    data = [[1, 3, 2, 4]] + [[r.random() for _ in range(7)] for _ in range(20)]
    rows = spark.createDataFrame([(g, i, float(y)) for g, ys in enumerate(data) for i, y in enumerate(ys)], "g int, x int, y double")
    got = {}
    for row in ladder.isotonic(rows, ["g"], "x", "y").orderBy("g", "x").collect():
        got.setdefault(row.g, []).append(row.fitted)
    assert got[0] == [1, 2.5, 2.5, 4]
    for g, ys in enumerate(data):
        blocks = []
        for y in ys:
            blocks.append([y, 1])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                (a, m), (b, n) = blocks[-2:]
                blocks[-2:] = [[(a * m + b * n) / (m + n), m + n]]
        assert np.allclose(got[g], [v for v, n in blocks for _ in range(n)])


def test_isotonic_takes_a_long_curve(spark):
    r = random.Random(2)
    ys = [i / 1000 + r.gauss(0, 3) for i in range(20_000)]
    fit = ladder.isotonic(spark.createDataFrame([(1, i, y) for i, y in enumerate(ys)], "g int, x long, y double"), ["g"], "x", "y")
    assert "Join" not in fit._jdf.queryExecution().toString()  # the pairs of a long curve are too many
    blocks = []
    for y in ys:
        blocks.append([y, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            (a, m), (b, n) = blocks[-2:]
            blocks[-2:] = [[(a * m + b * n) / (m + n), m + n]]
    assert np.allclose([x.fitted for x in fit.orderBy("x").collect()], [v for v, n in blocks for _ in range(n)])


def test_curve_values(spark):
    p = spark.createDataFrame([(1, 720, 500_000, 60.0), (1, 720, 4_000_000, 92.0), (1, 720, 1_414_214, 80.0), (1, 720, 0, 5.0)], "title int, height int, bitrate long, vmaf double")
    rates = spark.createDataFrame([(1, 1_414_214.0), (1, 840_896.0), (1, 8e6), (1, 4e6)], "title int, rate double")
    got = {r.rate: r.quality for r in ladder.quality_at(ladder.curves(p), rates).collect()}
    assert got[1_414_214.0] == 80 and abs(got[840_896.0] - 70) < 1e-3 and got[4e6] == 92 and 8e6 not in got


def test_ladder_of_synthetic_probes(spark):
    rows = []
    for h, top, scale in ((1080, 99, 6e6), (720, 94, 3e6), (360, 78, 0.8e6)):
        for crf in range(18, 39, 5):
            b = int(scale * math.exp(-0.11 * (crf - 23)))
            rows.append((1, h, b, top * (1 - math.exp(-b / (0.4 * scale)))))
    hull = ladder.envelope(ladder.curves(spark.createDataFrame(rows, "title long, height int, bitrate long, vmaf double")))
    heights = [r.height for r in hull.orderBy("i").collect()]
    assert heights[0] == 360 and heights[-1] == 1080
    rungs = ladder.select_rungs(hull).orderBy("rung").collect()
    assert len(rungs) > 2
    assert all(1.49 <= a.rate / b.rate <= 2.51 and a.height >= b.height for a, b in zip(rungs, rungs[1:]))
    assert ladder.select_rungs(hull, rungs=3).count() == 3


def test_allocation_price(spark):
    menu = spark.createDataFrame([(1, u, i, 1.0 + i, 60.0 + 20 * math.sqrt(i) + u) for u in range(3) for i in range(5)], "title long, unit int, position int, rate double, quality double")
    r = ladder.allocation_price(menu, 80.0).first()
    assert r.quality >= 80
    assert {x.position for x in ladder.allocate(menu, 1e9).collect()} == {0}
    assert {x.position for x in ladder.allocate(menu, 0.0).collect()} == {4}


def test_ridge_recovers_weights(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((200, 2))
    rows = spark.createDataFrame([(1, float(a), float(b), float(3 + 2 * a - b)) for a, b in x], "g int, a double, b double, y double")
    m = ladder.train_models(rows, ["a", "b"], "y", ["g"], 1e-9)
    assert np.allclose(m.first().weights, [2, -1], atol=1e-6)
    assert ladder.predict(rows, m, ["a", "b"], ["g"]).agg(F.max(F.abs(F.col("predicted") - F.col("y")))).first()[0] < 1e-6


def test_packet_lines(spark):
    d = spark.createDataFrame([("pts_time=0.1|dts_time=0.0|duration_time=0.033|size=1234|flags=K__",), ("pts_time=N/A|dts_time=0.5|size=7|flags=___",)], "value string")
    assert [tuple(r) for r in ingest.packets(d).collect()] == [(100_000_000, 0, 33_000_000, 1234, True), (500_000_000, 500_000_000, 0, 7, False)]
    with pytest.raises(Exception, match="without a time"):
        ingest.packets(spark.createDataFrame([("pts_time=N/A|dts_time=N/A|size=7",)], "value string")).collect()


def test_first_pass_and_probe(spark):
    lines = [(1, i, f"in:{i} out:{i} type:{c} q:10.00 tex:100 mv:20") for i, c in enumerate("IPPIB")]
    got = ingest.first_pass(spark.createDataFrame(lines, "video_id int, seq int, value string")).orderBy("gop").collect()
    assert [(r.frames, r.tex) for r in got] == [(3, 300), (2, 200)]
    j = '{"streams":[{"codec_type":"video","codec_name":"hevc","width":3840,"height":2160,"pix_fmt":"yuv420p10le","color_transfer":"smpte2084","avg_frame_rate":"30000/1001","side_data_list":[{"side_data_type":"Mastering display metadata"}]},{"codec_type":"audio"},{"codec_type":"audio","disposition":{"default":1}}],"format":{"duration":"2.5"}}'
    r = ingest.probe(spark.createDataFrame([(j,)], "value string")).first()
    assert (r.bits, r.range, r.audio_track, r.seconds, round(r.fps, 3)) == (10, "HDR10", 1, 2.5, 29.97)


def test_corpus(spark, tmp_path):
    path = str(tmp_path / "corpus")
    rows = spark.createDataFrame([("grid", "t", "h264", "slow", 720, 30.0, 2, [10, 20], [80.0, 90.0], 1), ("grid", "t", "h264", "slow", 720, 30.0, 2, [11, 21], [81.0, 91.0], 2), ("grid", "t", "av1", "slow", 720, 30.0, 2, [1], [2.0], 3)], "kind string, source string, codec string, preset string, height int, crf double, segments int, bits array<bigint>, vmaf array<double>, seq bigint")
    ingest.append_corpus(rows, path)
    back = ingest.read_corpus(spark, path)
    assert [r.bits for r in ingest.corpus_points(back, "h264", "slow").orderBy("segment").collect()] == [11, 21]
    assert ingest.resume(rows.limit(1).withColumn("segments", F.lit(None).cast("int")), back).count() == 0


def test_overlap_and_asof(spark):
    a = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 10, 30), (2, 3, 0, 5)], "video_id int, id long, start long, end long")
    b = spark.createDataFrame([(1, 7, 5, 12), (1, 8, 29, 60), (2, 9, 5, 6)], "video_id int, id long, start long, end long")
    for width in (3, 100):
        assert sorted(tuple(r)[1:] for r in seq.overlap_join(a, b, width).collect()) == [(1, 7, 5), (2, 7, 2), (2, 8, 1)]
    left = spark.createDataFrame([(1, 5), (1, 100), (1, 8)], "video_id int, t long")
    right = spark.createDataFrame([(1, 4, 1), (1, 6, 2), (1, 10, 3)], "video_id int, pts long, i long")
    assert sorted(tuple(r)[1:] for r in seq.asof_forward(left, right, "i").collect()) == [(5, 2), (8, 3)]
    assert sorted(tuple(r)[1:3] for r in seq.asof_nearest(left, right, "i", 3).collect()) == [(5, 2), (8, 3)]


def test_loudness_of_a_constant(spark):
    steps = spark.createDataFrame([(1, i, i * S // 10, 0.01) for i in range(50)], "video_id int, pos long, pts long, energy double")
    assert audio.gated(steps).first().integrated == round(-0.691 + 10 * math.log10(0.01), 2)
    assert audio.loudness_range(steps).first().range == 0
    assert audio.windowed(steps, 4).where("step = 0").first().energy == 0.0025


def test_verdict(spark):
    v = spark.createDataFrame([(1,), (2,), (3,)], "video_id int")
    f = spark.createDataFrame([(1, "warn", "muted-channel"), (1, "warn", "x"), (2, "warn", "x"), (2, "ok", "y")], "video_id int, level string, code string")
    assert {r.video_id: r.verdict for r in findings.verdict(v, f).collect()} == {1: "fail", 2: "attention", 3: "pass"}


def test_transfer_round_trip(spark):
    d = spark.range(0, 101).select((F.col("id") / 100.0).alias("e"))
    assert d.select(F.max(F.abs(fn.nits_to_pq(fn.pq_to_nits(F.col("e"))) - F.col("e")))).first()[0] < 1e-6  # black itself is 7.3e-7
    assert spark.range(1).select(fn.timecode(F.lit(3_661_005_000_000))).first()[0] == "01:01:01.01"


def test_streaming_tumbling(spark, tmp_path):
    from framewise.streaming import rates

    src = str(tmp_path / "in")
    spark.sql("SELECT 1 AS video_id, timestamp'2024-01-01 00:10:00' AS ts, 5L AS size UNION ALL SELECT 1, timestamp'2024-01-01 00:20:00', 7L").coalesce(1).write.parquet(src)
    df = rates.tumbling(spark.readStream.schema("video_id int, ts timestamp, size long").parquet(src), "1 hour")
    q = df.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.bytes, r.n) for r in spark.table("rates").collect()] == [(12, 2)]
