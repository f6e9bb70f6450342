"""Rules over reports: one narrow select each, united; and the verdict."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("warn", "info", "ok")
#: Codes whose warning fails a video.
BLOCKING = ("silent-track", "muted-channel", "inverted-polarity", "true-peak-over", "hdr-primaries", "hdr-matrix", "hdr-bit-depth", "no-rungs")


class Rule(NamedTuple):
    """A finding of a report row: when it holds, and the value and limit that go with it, in SQL over the row's columns."""

    code: str
    level: str
    topic: str
    when: str
    value: str = "0"
    limit: str = "0"


# Codes, levels, topics and limits of the reports' rules.
BITSTREAM = (
    Rule("peak-bitrate", "warn", "bitrate", "peak_to_average > 2", "peak_to_average", "2"),
    Rule("keyframe-interval", "warn", "bitrate", "keyframes > 1 AND max_interval > 4", "max_interval", "4"),
)
VIDEO = (
    Rule("black-segments", "warn", "complexity", "black > 0"),
    Rule("frozen-segments", "warn", "complexity", "frozen > 0"),
    Rule("black-bars", "warn", "", "letterbox OR pillarbox"),
    Rule("levels-out-of-range", "warn", "", "out_of_range > 0.01", "out_of_range", "0.01"),
    Rule("no-black-or-frozen", "ok", "", "black + frozen = 0"),
    Rule("shaky-shots", "info", "motion", "shaky > 0", "worst_shake"),
    Rule("interlaced", "warn", "", "field_order <> '' AND field_order <> 'progressive'"),
)
HEARD, IN_TARGET, PEAK_OK = "integrated > -120", "abs(integrated - target) <= tolerance", "true_peak <= max_true_peak"
AUDIO = (
    Rule("audio-sample-rate", "warn", "audio", "sample_rate > 0 AND sample_rate < 32000", "sample_rate"),
    Rule("audio-sample-rate", "info", "audio", "sample_rate >= 32000 AND sample_rate <> 48000", "sample_rate"),
    Rule("audio-bit-depth", "warn", "audio", "bit_depth > 0 AND bit_depth < 16", "bit_depth"),
    Rule("audio-layout-guessed", "info", "audio", "layout_guessed"),
    Rule("audio-offset", "info", "audio", "abs(start_offset) >= 0.001", "start_offset"),
    Rule("silent-track", "warn", "audio", f"NOT ({HEARD})", "sample_peak"),
    Rule("loudness-off-target", "warn", "audio", f"{HEARD} AND NOT ({IN_TARGET})", "integrated", "target"),
    Rule("true-peak-over", "warn", "audio", f"{HEARD} AND NOT ({PEAK_OK})", "true_peak", "max_true_peak"),
    Rule("loudness-on-target", "ok", "audio", f"{HEARD} AND {IN_TARGET} AND {PEAK_OK}", "integrated", "target"),
    Rule("leading-silence", "info", "audio", f"{HEARD} AND lead_silence > 0", "lead_silence"),
    Rule("trailing-silence", "info", "audio", f"{HEARD} AND trail_silence > 0", "trail_silence"),
    Rule("audio-silence", "warn", "audio", f"{HEARD} AND silences > 0"),
)
CHANNEL = (
    Rule("empty-lfe", "info", "audio", "muted AND channel IN ('LFE', 'LFE2')"),
    Rule("empty-centre", "warn", "audio", "muted AND channel = 'FC' AND surround"),
    Rule("muted-channel", "warn", "audio", "muted AND NOT (channel IN ('LFE', 'LFE2') OR channel = 'FC' AND surround)"),
    Rule("channel-silence", "warn", "audio", "NOT muted AND silences > 0 AND (NOT surround OR channel IN ('FL', 'FR', 'DL', 'DR') OR channel LIKE 'C0%' OR channel LIKE 'C1%')"),
    Rule("dc-offset", "warn", "audio", "abs(dc) > 0.00316", "dc", "0.00316"),
    Rule("clipping", "warn", "audio", "clipped > 0", "clipped"),
)
PAIR = (
    Rule("inverted-polarity", "warn", "audio", "correlation <= -0.5", "correlation"),
    Rule("out-of-phase", "warn", "audio", "correlation > -0.5 AND out_of_phase > 0"),
    Rule("mono-as-stereo", "info", "audio", "identical", "difference"),
)
LIT = "hdr AND transfer = 'smpte2084' AND mastering"
CLL_OVER, CLL_UNDER = "max_cll > 0 AND robust_cll > max_cll * 1.25", "max_cll > 0 AND robust_cll <= max_cll * 1.25 AND measured_cll < max_cll / 1.25"
FALL_OVER, FALL_UNDER = "max_fall > 0 AND measured_fall > max_fall * 1.15", "max_fall > 0 AND measured_fall < max_fall / 1.15"
HDR = (
    Rule("dolby-vision", "info", "", "dolby_profile > 0", "dolby_profile"),
    Rule("hdr10-plus", "info", "", "hdr10_plus"),
    Rule("hdr-primaries", "warn", "", "hdr AND primaries <> '' AND primaries <> 'bt2020'"),
    Rule("hdr-matrix", "warn", "", "hdr AND matrix <> '' AND matrix NOT IN ('bt2020nc', 'bt2020c', 'ictcp')"),
    Rule("hdr-bit-depth", "warn", "", "hdr AND bits > 0 AND bits < 10", "bits"),
    Rule("hdr-full-range", "info", "", "hdr AND colour_range IN ('pc', 'jpeg')"),
    Rule("missing-mastering-display", "warn", "", "hdr AND transfer = 'smpte2084' AND NOT mastering"),
    Rule("missing-content-light", "warn", "light", f"{LIT} AND max_cll = 0 AND max_fall = 0", "robust_cll", "measured_fall"),
    Rule("content-brighter-than-signalled", "warn", "light", f"{LIT} AND {CLL_OVER}", "robust_cll", "max_cll"),
    Rule("content-dimmer-than-signalled", "info", "light", f"{LIT} AND {CLL_UNDER}", "measured_cll", "max_cll"),
    Rule("content-brighter-than-signalled", "warn", "light", f"{LIT} AND {FALL_OVER}", "measured_fall", "max_fall"),
    Rule("content-dimmer-than-signalled", "info", "light", f"{LIT} AND {FALL_UNDER}", "measured_fall", "max_fall"),
    Rule("light-levels-match", "ok", "light", f"{LIT} AND max_cll + max_fall > 0 AND NOT ({CLL_OVER}) AND NOT ({CLL_UNDER}) AND NOT ({FALL_OVER}) AND NOT ({FALL_UNDER})", "robust_cll", "measured_fall"),
)
COMPARISON = (
    Rule("fallback", "info", "", "fallback <> ''"),
    Rule("budget-clamped", "info", "", "clamped <> ''"),
    Rule("worst-frame", "warn", "quality", "worst < mean - 15", "worst"),
    Rule("drops", "info", "quality", "drops >= 0.05", "drops", "drop_threshold"),
    Rule("no-banding", "ok", "", "banded_segments = 0", "0", "5"),
    Rule("banding", "warn", "banding", "banded_segments > 0", "0", "5"),
    Rule("sampled-only", "info", "", "sampled"),
)
#: Of a ladder: its first rung and its rungs' largest gap to their predictions.
LADDER = (
    Rule("no-rungs", "warn", "", "rungs = 0"),
    Rule("top-vmaf-missed", "warn", "", "rungs > 0 AND top_quality < target - 0.5", "top_quality", "target"),
    Rule("top-vmaf-reached", "ok", "", "rungs > 0 AND top_quality >= target - 0.5", "top_quality", "target"),
    Rule("lighter-than-apple", "ok", "", "rungs > 0 AND codec = 'h264' AND top_rate < 7800000", "1 - top_rate / 7800000", "7800000"),
    Rule("verification", "warn", "", "rungs > 0 AND verified AND worst_gap > step / 2", "worst_gap", "step / 2"),
    Rule("verification", "ok", "", "rungs > 0 AND verified AND worst_gap <= step / 2", "worst_gap", "step / 2"),
)
#: Of each rung; gap: a title's quality less the program's.
RUNG = (
    Rule("extrapolated", "warn", "", "extrapolated"),
    Rule("per-shot-rejected", "info", "", "per_shot_gain <= 0", "0 - per_shot_gain"),
    Rule("banded-source", "warn", "", "banded >= 0.05 AND inherited >= 0.5", "banded", "5"),
    Rule("banded-rung", "warn", "", "banded >= 0.05 AND inherited < 0.5", "banded", "5"),
)
TITLE = (
    Rule("title-below-program", "warn", "", "quality - program < -2", "quality", "program"),
    Rule("title-above-program", "info", "", "quality - program > 2", "quality", "program"),
)
DIGITS = 6


def found(report: DataFrame, rules: tuple[Rule, ...], keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """keys, seq, level, code, topic, value, limit: a row for each rule that holds of a report row, in one pass over the report."""
    one = [
        F.when(F.expr(r.when), F.struct(F.lit(i + 1).alias("seq"), F.lit(r.level).alias("level"), F.lit(r.code).alias("code"), F.lit(r.topic).alias("topic"), F.round(F.expr(r.value).cast("double"), DIGITS).alias("value"), F.expr(r.limit).cast("double").alias("limit")))
        for i, r in enumerate(rules)
    ]
    f = report.select(*keys, F.explode(F.filter(F.array(*one), lambda x: x.isNotNull())).alias("f"))
    return f.select(*keys, "f.*")


def found_sql(report: str, rules: tuple[Rule, ...], keys: tuple[str, ...] = ("video_id",)) -> str:
    """The same as SQL over a table or common table expression."""
    k = ", ".join(keys)
    return " UNION ALL ".join(
        f"SELECT {k}, {i + 1} AS seq, '{r.level}' AS level, '{r.code}' AS code, '{r.topic}' AS topic, round(CAST({r.value} AS DOUBLE), {DIGITS}) AS value, CAST({r.limit} AS DOUBLE) AS \"limit\" FROM {report} WHERE {r.when}" for i, r in enumerate(rules)
    )


def program_even(titles: DataFrame) -> DataFrame:
    """One ok row for each program none of whose titles lies more than 2 off (titles: program_id, quality, program)."""
    gap = F.max(F.abs(F.col("quality") - F.col("program")))
    g = titles.groupBy("program_id").agg(F.count("*").alias("n"), gap.alias("worst"))
    return g.where("n > 1 AND worst <= 2").select("program_id", F.lit("ok").alias("level"), F.lit("program-even").alias("code"), F.round("worst", DIGITS).alias("value"), F.lit(2.0).alias("limit"))


def codec_rules(rates: DataFrame, oldest: str, tolerance: float = 0.03) -> DataFrame:
    """rates: video_id, codec, rate; each codec against the oldest of its video."""
    base = rates.where(F.col("codec") == oldest).select("video_id", F.col("rate").alias("base"))
    g = rates.where(F.col("codec") != oldest).join(base, "video_id").withColumn("gap", F.round(F.col("rate") / F.col("base") - 1, 6))
    return g.select("video_id", "codec", F.when(F.col("gap") < -tolerance, "saving").when(F.col("gap") > tolerance, "costlier").otherwise("even").alias("code"), "gap")


def ranked(findings: DataFrame) -> DataFrame:
    level = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    return findings.orderBy("video_id", level, "seq")


def verdict(videos: DataFrame, findings: DataFrame) -> DataFrame:
    """fail with a blocking warning, attention with another, else pass; for every video."""
    severity = F.max(F.when((F.col("level") == "warn") & F.col("code").isin(*BLOCKING), 2).when(F.col("level") == "warn", 1).otherwise(0))
    v = videos.select("video_id").distinct().join(findings.groupBy("video_id").agg(severity.alias("s")), "video_id", "left")
    return v.select("video_id", F.when(F.col("s") == 2, "fail").when(F.col("s") == 1, "attention").otherwise("pass").alias("verdict"))


def rank_conflicts(rungs: DataFrame, vmaf_margin: float = 2.0, other_margin: float = 0.5) -> DataFrame:
    """Pairs of a video's rungs that two metrics order differently by their margins; a ladder has a few rungs."""
    a, b = rungs.alias("a"), rungs.alias("b")
    on = (F.col("a.video_id") == F.col("b.video_id")) & (F.col("a.rung") != F.col("b.rung")) & (F.col("a.vmaf") - F.col("b.vmaf") >= vmaf_margin) & (F.col("b.xpsnr") - F.col("a.xpsnr") >= other_margin)
    return a.join(b, on).select(F.col("a.video_id").alias("video_id"), F.col("a.rung").alias("better"), F.col("b.rung").alias("worse"))
