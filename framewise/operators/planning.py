"""Planning a ladder: candidate heights, digest pieces of shots, feature sets, checks of measured rungs, challengers and the bend of a title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from . import ladder, seq

# Prefixes of features that need an encode, the source's quantisers, and of those no longer fitted.
ENCODE, SOURCE, RETIRED = "x264_", "src_", "scale_"
# Quality gaps beyond which a rung, and the top rung, are corrected.
TOLERANCE, TOP_TOLERANCE = 1.5, 0.5
# Fixed values of the luma weight over 10-bit code values: slope, offset, least and greatest exponent.
WEIGHT = (0.015, -7.5, -3.0, 6.0)


def candidate_heights(titles: DataFrame, heights: list[int]) -> DataFrame:
    """titles (title, source) with each of the heights not above the source, once and in their order; the source's own where all are above it."""
    fits = F.filter(F.array_distinct(F.array(*[F.lit(h) for h in heights])), lambda h: h <= F.col("source"))
    return titles.select("title", "source", F.posexplode(F.when(F.size(fits) > 0, fits).otherwise(F.array(F.col("source").cast("int")))).alias("place", "height"))


def digest_pieces(shots: DataFrame, segments: DataFrame, width: int) -> DataFrame:
    """The parts of shots (title, shot, start, frames) that the segments (title, segment, start, frames) of a digest hold, in frames of the digest,
    which is its segments end to end."""
    before = Window.partitionBy("title").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    s = segments.withColumn("offset", F.coalesce(F.sum("frames").over(before), F.lit(0).cast("long")))
    span = lambda d, i: d.select(F.col("title").alias("video_id"), F.col(i).alias("id"), F.col("start"), (F.col("start") + F.col("frames")).alias("end"))
    both = seq.overlap_join(span(s, "segment"), span(shots, "shot"), width).select(F.col("video_id").alias("title"), F.col("a_id").alias("segment"), F.col("b_id").alias("shot"))
    at = s.select("title", "segment", "offset", F.col("start").alias("s0"), (F.col("start") + F.col("frames")).alias("s1"))
    in_shot = shots.select("title", "shot", F.col("start").alias("t0"), (F.col("start") + F.col("frames")).alias("t1"))
    a, b = F.greatest("s0", "t0"), F.least("s1", "t1")
    return both.join(at, ["title", "segment"]).join(in_shot, ["title", "shot"]).select("title", "segment", "shot", (F.col("offset") + a - F.col("s0")).alias("start"), (b - a).alias("frames"))


def feature_sets(names: DataFrame) -> DataFrame:
    """names (name) in each set a model is fitted on without anchors: 0 all, 1 without the source's quantisers, 2 without encodes, 3 without both."""
    encode, source = F.col("name").startswith(ENCODE), F.col("name").startswith(SOURCE)
    sets = F.when(encode, F.array(F.lit(0), F.lit(1))).when(source, F.array(F.lit(0), F.lit(2))).otherwise(F.sequence(F.lit(0), F.lit(3)))
    return names.where(~F.col("name").startswith(RETIRED)).select("name").distinct().select(F.explode(sets).alias("set"), "name")


def luma_weight(code: Column, depth: int) -> Column:
    """The weight of a luma code value of ``depth`` bits in a weighted PSNR."""
    slope, offset, least, most = WEIGHT
    return F.pow(F.lit(2.0), F.least(F.greatest(code * 2.0 ** (10 - depth) * slope + offset, F.lit(least)), F.lit(most)) / 3)


def slopes_at(rungs: DataFrame, probes: DataFrame) -> DataFrame:
    """rungs (title, height, rung, crf) with the slope of quality over CRF between the probes (title, height, crf, quality) around their CRF, the last
    two beyond the ends; 0 with fewer than two probes or between equal CRFs."""
    w = Window.partitionBy("title", "height").orderBy("crf", "quality")
    p = probes.select("title", "height", F.lag("crf").over(w).alias("c0"), F.lag("quality").over(w).alias("q0"), F.col("crf").alias("c1"), F.col("quality").alias("q1"), F.row_number().over(w).alias("i")).where("i > 1")
    slope = F.when(F.col("c1") == F.col("c0"), 0.0).otherwise((F.col("q1") - F.col("q0")) / F.nullif(F.col("c1") - F.col("c0"), F.lit(0.0)))
    beyond = F.col("c1") < F.col("crf")
    j = rungs.select("title", "height", "rung", "crf").join(p, ["title", "height"]).groupBy("title", "height", "rung", "crf").agg(F.min_by(slope, F.struct(beyond, F.when(beyond, -F.col("i")).otherwise(F.col("i")))).alias("slope"))
    return rungs.join(j, ["title", "height", "rung", "crf"], "left").fillna(0.0, ["slope"])


def calibrated(rungs: DataFrame, probes: DataFrame, step: float, low: float, high: float) -> DataFrame:
    """rungs (title, height, rung, crf, top, predicted, measured) after one secant step of their CRF where the measured quality misses the prediction by
    more than the tolerance and quality falls with CRF: title, rung, next_crf, calibrated. A rung without a measure stays."""
    r = slopes_at(rungs, probes)
    missed = F.abs(F.col("measured") - F.col("predicted")) > F.when(F.col("top"), TOP_TOLERANCE).otherwise(TOLERANCE)
    moved = fn.crf_step(F.col("crf") + (F.col("predicted") - F.col("measured")) / F.nullif(F.col("slope"), F.lit(0.0)), step, low, high)
    nxt = F.when(missed & (F.col("slope") < 0), moved).otherwise(F.col("crf"))
    return r.select("title", "rung", nxt.alias("next_crf"), (nxt != F.col("crf")).alias("calibrated"))


def challengers(rungs: DataFrame, curve: DataFrame) -> DataFrame:
    """rungs (title, height of their curve, rate) with each higher curve (title, height, bitrate, fitted) that is probed only above their rate, beats their
    curve at its own lowest probe, and, drawn on along its lowest segment that rises, at their rate too."""
    w = Window.partitionBy("title", "height").orderBy("bitrate")
    rising = F.min(F.when(F.col("fitted") > F.col("top"), F.struct("bitrate", "fitted")))
    c = curve.withColumn("top", F.first("fitted").over(w)).groupBy("title", "height").agg(F.min("bitrate").alias("low"), F.min("top").alias("top"), rising.alias("up"))
    higher = c.select("title", F.col("height").alias("challenger"), "low", "top", "up")
    r = rungs.select("title", "height", "rate").distinct().join(higher, "title").where("challenger > height AND rate < low")
    drawn = F.col("top") + (F.ln("rate") - F.ln("low")) * (F.col("up.fitted") - F.col("top")) / (F.ln("up.bitrate") - F.ln("low"))
    asked = r.select("title", "rate").union(r.select("title", F.col("low").alias("rate"))).distinct()
    own = ladder.quality_at(curve, asked)
    at_low = own.select("title", "height", F.col("rate").alias("low"), F.col("quality").alias("own_low"))
    j = r.join(at_low, ["title", "height", "low"], "left").join(own, ["title", "height", "rate"], "left")
    wins = F.coalesce(F.col("own_low") < F.col("top"), F.lit(True)) & F.coalesce(F.coalesce(drawn, F.lit(0.0)) > F.col("quality"), F.lit(True))
    return j.where(wins).select("title", "height", "rate", "challenger")


def title_bend(probes: DataFrame, least: int = 3) -> DataFrame:
    """The second-order terms over CRF of ln(rate) and quality of each title and height, by least squares on the probes (crf, rate, quality, and the range
    low, high of CRFs in use) within the range's width of its middle, and beyond it only until ``least`` CRFs are held; 0 with fewer CRFs."""
    p = probes.where("rate > 0").withColumn("d", F.col("crf") - (F.col("low") + F.col("high")) / 2)
    by = Window.partitionBy("title", "height")
    first = F.row_number().over(Window.partitionBy("title", "height", "crf").orderBy("rate", "quality")) == 1
    p = p.withColumn("new", first.cast("int")).withColumn("held", F.coalesce(F.sum("new").over(by.orderBy(F.abs("d"), "crf", F.desc("new"), "rate", "quality").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    p = p.where((F.abs("d") <= F.col("high") - F.col("low")) | (F.col("held") < least))
    y = {"rate": F.ln("rate"), "quality": F.col("quality")}
    sums = [F.sum(F.pow("d", F.lit(k))).alias(f"s{k}") for k in range(5)] + [F.sum(v * F.pow("d", F.lit(k))).alias(f"{n}{k}") for n, v in y.items() for k in range(3)]
    g = p.groupBy("title", "height").agg(F.sum("new").alias("crfs"), *sums)
    s0, s1, s2, s3, s4 = (F.col(f"s{k}") for k in range(5))
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)

    def bend(n: str) -> Column:
        t0, t1, t2 = (F.col(f"{n}{k}") for k in range(3))
        top = s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)
        return F.when(F.col("crfs") < least, 0.0).otherwise(top / F.nullif(det, F.lit(0.0))).alias(f"{n}_bend")

    return g.select("title", "height", bend("rate"), bend("quality"))


def merged_clips(segments: DataFrame) -> DataFrame:
    """One row a clip of its consecutive segments (clip, segment, first, stop, decoded): from the first one's start to the last one's end."""
    return segments.groupBy("clip").agg(F.min_by("first", "segment").alias("first"), F.max_by("stop", "segment").alias("stop"), F.sum("decoded").alias("decoded"))


def merged_frames(frames: DataFrame) -> DataFrame:
    """Frames (clip, segment, frame, score) with their place in the whole clip. Frames are ordered within their segment only; the segments' lengths, a row
    each, are summed up along the clip."""
    before = Window.partitionBy("clip").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    held = frames.groupBy("clip", "segment").agg(F.count("*").alias("n")).select("clip", "segment", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("held"))
    own = F.row_number().over(Window.partitionBy("clip", "segment").orderBy("frame", "score")) - 1
    return frames.withColumn("own", own).join(held, ["clip", "segment"]).select("clip", (F.col("held") + F.col("own")).alias("place"), "score")


def measurement(encodes: DataFrame, means: DataFrame) -> DataFrame:
    """encodes (encode and its own columns) with the means (encode, kind metric or device, name, mean) of each kind as a map; null where none was measured."""
    entry = F.struct("name", "mean")
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, entry))
    m = means.groupBy("encode").agg(*[F.when(F.size(of(k)) > 0, F.map_from_entries(of(k))).alias(f"{k}s") for k in ("metric", "device")])
    return encodes.join(m, "encode", "left")
