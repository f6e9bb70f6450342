"""Grouped reports of frames, channels, shots and titles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .seq import in_order


def box_union(boxes: DataFrame) -> DataFrame:
    """The smallest box on even coordinates that holds a video's boxes (x0, y0, x1, y1)."""
    down, up = lambda c: F.floor(c / 2) * 2, lambda c: F.ceil(c / 2) * 2
    return boxes.groupBy("video_id").agg(*[down(F.min(c)).cast("long").alias(c) for c in ("x0", "y0")], *[up(F.max(c)).cast("long").alias(c) for c in ("x1", "y1")])


def channel_stats(steps: DataFrame, channel: str, other: str, clip: float, silence: float) -> DataFrame:
    """Offset, level, peak, clipped steps, silent share; muted if silent in 99 % of the steps in which the other channel is active."""
    x, on = F.col(channel), F.abs(F.col(other)) >= silence
    quiet = F.abs(x) < silence
    return steps.groupBy("video_id").agg(
        F.round(F.avg(x), 6).alias("dc"), F.round(F.sqrt(F.avg(x * x)), 6).alias("rms"), F.max(F.abs(x)).alias("peak"), F.count_if(F.abs(x) >= clip).alias("clipped"),
        F.round(F.avg(quiet.cast("double")), 6).alias("silent"), ((F.count_if(quiet & on) >= 0.99 * F.count_if(on)) & (F.count_if(on) > 0)).alias("muted"),
    )


def collapsed_variance(strata: DataFrame) -> DataFrame:
    """Variance of a stratified mean of one clip a stratum: neighbouring strata go in twos, the last three together if their number is odd, and the spread
    within a group stands for the error of its strata. strata: video_id, stratum, w (share of frames), m (clip mean), slots. Strata of one
    slot have no error; videos with fewer than two others give no row."""
    rank = Window.partitionBy("video_id").orderBy("stratum")
    s = strata.where("slots > 1").withColumns({"_i": F.row_number().over(rank) - 1, "_c": F.count("*").over(Window.partitionBy("video_id"))}).where("_c >= 2")
    s = s.withColumn("_g", F.least(F.floor(F.col("_i") / 2), F.floor(F.col("_c") / 2) - 1))
    g = Window.partitionBy("video_id", "_g")
    s = s.withColumns({"_mid": F.sum(F.col("w") * F.col("m")).over(g) / F.sum("w").over(g), "_k": F.count("*").over(g)})
    off = F.col("w") * (F.col("m") - F.col("_mid"))
    part = F.col("_k") / (F.col("_k") - 1) * (1 - 1 / F.col("slots")) * off * off
    return s.groupBy("video_id").agg(F.sum(part).alias("variance"), (F.max("_c") - F.floor(F.max("_c") / 2)).alias("df"))


def banding(frames: DataFrame, gap: int) -> DataFrame:
    """Share of banded frames, the part of them the source has too, and the number of their sessions."""
    w = in_order("pos")
    goes_on = F.coalesce(F.lag("banded").over(w) & (F.col("pts") - F.lag("pts").over(w) <= gap), F.lit(False))
    f = frames.withColumn("_new", F.col("banded") & ~goes_on)
    share = F.count_if(F.col("banded") & F.col("source")) / F.nullif(F.count_if("banded"), F.lit(0))
    return f.groupBy("video_id").agg(F.round(F.avg(F.col("banded").cast("double")), 6).alias("banded"), F.round(share, 6).alias("inherited"), F.count_if("_new").alias("segments"))


def class_shares(shots: DataFrame) -> DataFrame:
    """Shots, frames and share of each class, the longest first; of equals the one that came first. The share is rounded as a multiple of 1e-6, as DuckDB
    does: a half of its seventh digit, as in 41 frames of 640, goes by the double and not by its shortest decimal."""
    g = shots.groupBy("video_id", "class").agg(F.count("*").alias("shots"), F.sum("frames").alias("frames"), F.min("start").alias("_first"))
    v = Window.partitionBy("video_id")
    share = F.round(F.col("frames") / F.sum("frames").over(v) * 1e6) / 1e6
    return g.select("video_id", "class", "shots", "frames", share.alias("share"), F.row_number().over(v.orderBy(F.desc("frames"), "_first")).cast("long").alias("place"))


def validation_errors(errors: DataFrame) -> DataFrame:
    """errors: point, title, err (absolute); by point."""
    r = lambda c: F.round(c, 6)
    return errors.groupBy("point").agg(F.count_distinct("title").alias("titles"), r(F.avg("err")).alias("mean"), r(stats.nearest_rank("err", 0.95)).alias("p95"), r(F.max("err")).alias("worst"))


def coverage(runs: DataFrame) -> DataFrame:
    """runs: design, error, half, fallback."""
    r = lambda c: F.round(c, 6)
    e = F.col("error")
    return runs.groupBy("design").agg(F.count("*").alias("runs"), r(F.avg((F.abs(e) <= F.col("half")).cast("double"))).alias("coverage"), r(F.sqrt(F.avg(e * e))).alias("rmse"), r(F.avg("half")).alias("half_width"), F.count_if("fallback").alias("fallbacks"))


def even_segments(titles: DataFrame, budget: int, segment: int) -> DataFrame:
    """title, k, start, length: budget // segment pieces, each in the middle of its share of the title (dur); a title within the budget is one piece."""
    n = max(1, budget // segment)
    whole = F.col("dur") <= budget
    t = titles.withColumn("k", F.explode(F.sequence(F.lit(0), F.when(whole, 0).otherwise(n - 1))))
    centred = F.expr(f"(2 * k + 1) * dur div {2 * n}") - segment // 2
    return t.select("title", "k", F.when(whole, 0).otherwise(centred).alias("start"), F.when(whole, F.col("dur")).otherwise(segment).alias("length"))


def transfer(rows: DataFrame, low: tuple[int, float, float], high: tuple[int, float, float]) -> DataFrame:
    """rows (height, rate) with the CRF offset and the rate of another preset; anchors (height, CRF offset, log rate ratio) are joined in a line over ln(height)."""
    at = (F.ln("height") - math.log(low[0])) / (math.log(high[0]) - math.log(low[0]))
    line = lambda i: low[i] + (high[i] - low[i]) * at
    return rows.withColumn("crf_offset", line(1)).withColumn("rate", F.col("rate") * F.exp(line(2)))


def move_class(x: Column, y: Column, still: float = 5.0) -> Column:
    """Class and direction of a frame's movement; one axis rules if it is twice the other."""
    return (
        F.when(F.hypot(x, y) < still, "static").when(F.abs(x) >= 2 * F.abs(y), F.when(x > 0, "pan-right").otherwise("pan-left"))
        .when(F.abs(y) >= 2 * F.abs(x), F.when(y > 0, "tilt-down").otherwise("tilt-up")).otherwise("mixed")
    )
