"""Per-segment and per-title features from frames, spans and statistics."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import link

PSNR_CAP, EVERY, BANDED = 60.0, 10, 5.0


def log_rate(bits: Column, frames: Column, rate: float, pixels: float) -> Column:
    """ln of bits per second and pixel of a group of pictures, one bit added."""
    return F.ln((bits + 1) / (frames / rate) / pixels)


def segment_scores(scored: DataFrame, titles: DataFrame, per_segment: int) -> DataFrame:
    """Logit of the mean score of each segment of a title (titles: title, segments); a segment without scored frames takes the title's mean.
    Frames beyond the segments count in that mean only."""
    every = titles.select("title", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)).alias("segment"))
    s = scored.groupBy("title", F.expr(f"cast(frame div {per_segment} as int)").alias("segment")).agg(F.sum("score").alias("s"), F.count("score").alias("n"))
    whole = s.groupBy("title").agg((F.sum("s") / F.sum("n")).alias("all"))
    return every.join(s, ["title", "segment"], "left").join(whole, "title").select("title", "segment", link(F.coalesce(F.col("s") / F.col("n"), F.col("all"))).alias("score"))


def segment_means(frames: DataFrame, per_segment: int) -> DataFrame:
    """Mean quantiser of each whole segment of a title, and whether the title's frames fill it."""
    g = frames.groupBy("title", F.expr(f"frame div {per_segment}").alias("segment")).agg(F.avg("qp").alias("qp"), F.count("*").alias("n"))
    return g.select("title", "segment", "qp", (F.col("n") == per_segment).alias("whole"))


def scale_loss(frames: DataFrame, per_segment: int) -> DataFrame:
    """Mean PSNR, capped, of a segment's every tenth frame after scaling down and up (frames: title, k, psnr; k counts the measured frames)."""
    return frames.groupBy("title", F.expr(f"k * {EVERY} div {per_segment}").alias("segment")).agg(F.avg(F.least("psnr", F.lit(PSNR_CAP))).alias("loss"))


def snapped_to_gops(segments: DataFrame, gop: int, rate: float) -> DataFrame:
    """segments (title, idx, start, stop, duration) moved to the grid of groups of pictures, a quarter of a frame early; a title's stay as they are if one
    would then overlap the one before or pass the end."""
    w = Window.partitionBy("title").orderBy("idx")
    to = F.greatest(F.round(F.col("start") * rate / gop) * gop / rate - 0.25 / rate, F.lit(0.0))
    s = segments.withColumn("a", to).withColumn("b", F.col("a") + F.col("stop") - F.col("start"))
    s = s.withColumn("bad", (F.col("b") > F.col("duration")) | F.coalesce(F.col("a") < F.lag("b").over(w), F.lit(False)))
    s = s.withColumn("bad", F.max("bad").over(Window.partitionBy("title")))
    return s.select("title", "idx", F.when(F.col("bad"), F.col("start")).otherwise(F.col("a")).alias("start"), F.when(F.col("bad"), F.col("stop")).otherwise(F.col("b")).alias("stop"))


def banded_clips(frames: DataFrame) -> DataFrame:
    """Runs of frames with banding over the threshold within each clip (frames: title, clip, frame, cambi): first frame and the one after the last."""
    w = Window.partitionBy("title", "clip").orderBy("frame")
    f = frames.withColumn("n", F.row_number().over(w)).where(F.col("cambi") > BANDED)
    f = f.withColumn("run", F.col("n") - F.row_number().over(w))
    return f.groupBy("title", "clip", "run").agg(F.min("frame").alias("first"), (F.max("frame") + 1).alias("stop")).drop("run")


def spread(items: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """n items of each key evenly picked by position; all if there are no more."""
    w = Window.partitionBy(key)
    i = items.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_c": F.count("*").over(w)})
    i = i.withColumn("_j", F.expr(f"(_i * {n} + _c - 1) div _c"))  # the only pick that may fall on position i
    return i.where(f"_c <= {n} OR (_j < {n} AND _j * _c div {n} = _i)").drop("_i", "_c", "_j")


def placed(titles: DataFrame, frames: int, count: int) -> DataFrame:
    """Excerpts of ``frames`` frames in the middle of equal parts of each title (title, total, rate), as many as fit up to ``count``."""
    t = titles.withColumn("n", F.least(F.lit(count), F.expr(f"cast(total div {frames} as int)"))).where("n > 0 AND rate > 0")
    t = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    part = F.col("total") / F.col("n")
    first = F.floor(F.col("i") * part + (part - frames) / 2)
    start = F.greatest((first - 0.25) / F.col("rate"), F.lit(0.0))
    return t.select("title", "i", start.alias("start"), (start + frames / F.col("rate")).alias("stop"))


def title_measurements(sizes: DataFrame, scores: DataFrame, spans: DataFrame, rate: float) -> DataFrame:
    """Bitrate and mean quality of each title of a program from its span of frames (spans: program, title, first, stop). Spans don't overlap, so a frame
    meets its span by the last start at or before it."""
    def within(d: DataFrame) -> DataFrame:
        return d.join(spans, "program").where("frame >= first AND frame < stop")

    b = within(sizes).groupBy("program", "title").agg(F.round(F.sum("bytes") * 8 * rate / F.count("*")).cast("long").alias("bitrate"))
    q = within(scores).groupBy("program", "title").agg(F.count("*").alias("scored"), F.avg("score").alias("quality"))
    return spans.select("program", "title").join(b, ["program", "title"], "left").join(q, ["program", "title"], "left").select("program", "title", F.coalesce("bitrate", F.lit(0)).alias("bitrate"), F.coalesce("scored", F.lit(0)).alias("scored"), F.coalesce("quality", F.lit(0.0)).alias("quality"))


def scene_order(scenes: DataFrame) -> DataFrame:
    """Output order of scenes (title, source, segment, kind, score): the hardest first, or the easiest if those were asked for, then the others as they came."""
    rank = F.when(F.col("kind").isin("top", "easy"), 0).otherwise(1)
    by = F.when(F.col("kind") == "easy", F.col("score")).when(F.col("kind") == "top", -F.col("score")).otherwise(0.0)
    return scenes.withColumn("place", F.row_number().over(Window.partitionBy("title").orderBy(rank, by, "source", "segment", "score")))


def rest_of_pool(pool: DataFrame, picked: DataFrame) -> DataFrame:
    return pool.join(picked.select("title", "first"), ["title", "first"], "left_anti")


def overlay_track(tracks: DataFrame) -> DataFrame:
    """The analysed audio track an overlay shows: the default one, else the first."""
    return tracks.groupBy("title").agg(F.min_by("track", F.struct((~F.col("is_default")).alias("d"), F.col("position").alias("p"))).alias("track"))


def exact_mean(frames: DataFrame) -> DataFrame:
    """Mean of all frames: an interval of no width."""
    return frames.groupBy("title").agg(F.avg("score").alias("mean"), F.count("score").alias("frames")).withColumn("half_width", F.lit(0.0))


def grid_step(width: int, height: int, points: int) -> int:
    """The least even step of a sample grid with no more than so many whole cells over a picture."""
    return next(s for s in count(2, 2) if (width // s) * (height // s) <= points)
