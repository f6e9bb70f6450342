"""Rules, verdicts and rung selection against cases with known answers."""

import pytest

from framewise.operators import findings, ladder

HULL = [(1, 1_000_000.0, 60.0, 360), (1, 2_000_000.0, 80.0, 720), (1, 4_000_000.0, 96.0, 1080)]


@pytest.mark.parametrize(
    "options,heights",
    [({}, [1080, 720, 720, 360]), ({"min_quality": 70.0}, [1080, 720, 720]), ({"min_rate": 1_500_000.0}, [1080, 720, 720]), ({"rungs": 1}, [1080]), ({"max_rate": 2_100_000.0}, [720, 360])],
)
def test_rungs(spark, options, heights):
    hull = spark.createDataFrame(HULL, "title long, rate double, quality double, height int")
    got = ladder.select_rungs(hull, **options).orderBy("rung").collect()
    assert [r.height for r in got] == heights
    assert all(1.49 <= a.rate / b.rate <= 2.51 for a, b in zip(got, got[1:]))


def check(spark, rules, row, want):
    d = spark.createDataFrame([{"video_id": 1, **row}])
    assert {(r.code, r.level) for r in findings.found(d, rules).collect()} == want


def test_bitstream_rules(spark):
    for row, want in [
        ({"peak_to_average": 2.5, "keyframes": 3, "max_interval": 4.5}, {("peak-bitrate", "warn"), ("keyframe-interval", "warn")}),
        ({"peak_to_average": 2.0, "keyframes": 1, "max_interval": 9.0}, set()),  # one keyframe has no interval
    ]:
        check(spark, findings.BITSTREAM, row, want)


def test_audio_rules(spark):
    plain = {"sample_rate": 48000, "bit_depth": 24, "layout_guessed": False, "start_offset": 0.0, "integrated": -23.2, "sample_peak": -3.0, "target": -23.0, "tolerance": 0.5, "true_peak": -2.0, "max_true_peak": -1.0, "lead_silence": 0.0, "trail_silence": 0.0, "silences": 0}
    for change, want in [
        ({}, {("loudness-on-target", "ok")}),
        ({"integrated": -120.0, "silences": 2}, {("silent-track", "warn")}),  # a silent track is told alone
        ({"integrated": -20.0}, {("loudness-off-target", "warn")}),
        ({"true_peak": -0.5, "sample_rate": 44100}, {("true-peak-over", "warn"), ("audio-sample-rate", "info")}),
        ({"sample_rate": 22050, "lead_silence": 1.0, "silences": 1}, {("audio-sample-rate", "warn"), ("leading-silence", "info"), ("audio-silence", "warn"), ("loudness-on-target", "ok")}),
    ]:
        check(spark, findings.AUDIO, {**plain, **change}, want)
    channel = {"channel": "FL", "muted": False, "surround": False, "silences": 0, "dc": 0.0, "clipped": 0}
    for change, want in [
        ({"muted": True}, {("muted-channel", "warn")}),
        ({"muted": True, "channel": "LFE", "surround": True}, {("empty-lfe", "info")}),
        ({"muted": True, "channel": "FC", "surround": True}, {("empty-centre", "warn")}),
        ({"silences": 1, "channel": "BL", "surround": True}, set()),
        ({"silences": 1, "dc": -0.004, "clipped": 5}, {("channel-silence", "warn"), ("dc-offset", "warn"), ("clipping", "warn")}),
    ]:
        check(spark, findings.CHANNEL, {**channel, **change}, want)
    pair = {"correlation": 0.9, "out_of_phase": 0, "identical": False, "difference": -120.0}
    for change, want in [({"correlation": -0.5, "out_of_phase": 1}, {("inverted-polarity", "warn")}), ({"out_of_phase": 1}, {("out-of-phase", "warn")}), ({"identical": True}, {("mono-as-stereo", "info")})]:
        check(spark, findings.PAIR, {**pair, **change}, want)


def test_hdr_rules(spark):
    plain = {"dolby_profile": 0, "hdr10_plus": False, "hdr": True, "primaries": "bt2020", "matrix": "bt2020nc", "bits": 10, "colour_range": "tv", "transfer": "smpte2084", "mastering": True, "max_cll": 1000.0, "max_fall": 400.0, "robust_cll": 950.0, "measured_cll": 1000.0, "measured_fall": 390.0}
    for change, want in [
        ({}, {("light-levels-match", "ok")}),
        ({"mastering": False}, {("missing-mastering-display", "warn")}),
        ({"max_cll": 0.0, "max_fall": 0.0}, {("missing-content-light", "warn")}),
        ({"robust_cll": 1251.0, "measured_fall": 340.0}, {("content-brighter-than-signalled", "warn"), ("content-dimmer-than-signalled", "info")}),
        ({"hdr": False, "dolby_profile": 5, "bits": 8}, {("dolby-vision", "info")}),
        ({"primaries": "bt709", "matrix": "bt709", "bits": 8, "colour_range": "pc"}, {("hdr-primaries", "warn"), ("hdr-matrix", "warn"), ("hdr-bit-depth", "warn"), ("hdr-full-range", "info"), ("light-levels-match", "ok")}),
        ({"transfer": "arib-std-b67"}, set()),
    ]:
        check(spark, findings.HDR, {**plain, **change}, want)


def test_comparison_video_and_ladder_rules(spark):
    row = {"fallback": "", "clamped": "", "worst": 64.9, "mean": 80.0, "drops": 0.05, "drop_threshold": 70.0, "banded_segments": 0, "sampled": True}
    check(spark, findings.COMPARISON, row, {("worst-frame", "warn"), ("drops", "info"), ("no-banding", "ok"), ("sampled-only", "info")})
    row = {"black": 0, "frozen": 0, "letterbox": True, "pillarbox": False, "out_of_range": 0.011, "shaky": 2, "worst_shake": 0.4, "field_order": "tt"}
    check(spark, findings.VIDEO, row, {("black-bars", "warn"), ("levels-out-of-range", "warn"), ("no-black-or-frozen", "ok"), ("shaky-shots", "info"), ("interlaced", "warn")})
    row = {"rungs": 3, "top_quality": 94.5, "target": 95.0, "codec": "h264", "top_rate": 3_900_000.0, "verified": True, "worst_gap": 3.1, "step": 6.0}
    check(spark, findings.LADDER, row, {("top-vmaf-reached", "ok"), ("lighter-than-apple", "ok"), ("verification", "warn")})
    check(spark, findings.LADDER, {**row, "rungs": 0}, {("no-rungs", "warn")})
