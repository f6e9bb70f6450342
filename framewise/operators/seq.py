"""Sequence operators over rows of (video_id, pts, ...): windows, runs, sessions, as-of and range joins.

All windows are partitioned by ``video_id``. A position (``pos``) breaks ties of equal times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import NS


def in_order(*more: str) -> Window:
    return Window.partitionBy("video_id").orderBy("pts", *more)


def bitrate_series(packets: DataFrame, interval: int = NS) -> DataFrame:
    """video_id, bucket, start, bitrate: dense buckets from the first time; the last is measured over its real length, and
    packets beyond it count in it."""
    ends = packets.groupBy("video_id").agg(F.min("pts").alias("start"), (F.max("pts") + F.max_by("dur", F.struct("pts", "pos"))).alias("end"))
    ends = ends.withColumn("n", F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) / interval)).cast("long"))
    b = F.least(F.expr(f"(pts - start) div {interval}"), F.col("n") - 1)
    sums = packets.join(ends, "video_id").groupBy("video_id", b.alias("bucket")).agg(F.sum("size").alias("bytes"))
    dense = ends.select("video_id", "start", "end", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bucket")).withColumn("bucket", F.col("bucket").cast("long"))
    out = dense.join(sums, ["video_id", "bucket"], "left")
    length = F.when(F.col("bucket") == F.col("n") - 1, F.col("end") - F.col("start") - F.col("bucket") * interval).otherwise(interval)
    rate = F.when(length > 0, F.round(F.coalesce("bytes", F.lit(0)) * 8 / (length / NS))).otherwise(0).cast("long")
    return out.select("video_id", "bucket", (F.col("bucket") * interval).alias("start"), rate.alias("bitrate"))


def peak_bitrate(packets: DataFrame, window: int = NS) -> DataFrame:
    """The window [pts, pts + window) of the most bytes that begins at a packet; the first of equals."""
    w = Window.partitionBy("video_id").orderBy("pts").rangeBetween(0, window - 1)
    s = packets.select("video_id", "pts", "pos", F.sum("size").over(w).alias("bytes"))
    best = s.groupBy("video_id").agg(F.min_by(F.struct("pts", "bytes"), F.struct((-F.col("bytes")).alias("b"), "pts", "pos")).alias("m"))
    return best.select("video_id", F.col("m.pts").alias("pts"), F.round(F.col("m.bytes") * 8 / (window / NS)).cast("long").alias("bitrate"))


def trailing_bitrate(packets: DataFrame, window: int = NS) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy("pts").rangeBetween(-(window - 1), 0)
    return packets.select("video_id", "pos", "pts", F.round(F.sum("size").over(w) * 8 / (window / NS)).cast("long").alias("bitrate"))


def islands(rows: DataFrame, key: Column, name: str = "island") -> DataFrame:
    """Numbers each run of equal keys in time order."""
    w = in_order("pos")
    change = F.when(F.lag(key).over(w).eqNullSafe(key) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn(name, F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def flag_runs(rows: DataFrame, flag: Column, min_ns: int = 0) -> DataFrame:
    """video_id, start, end, n of the runs of a flag; a run ends at the next row's time, the last at the row's own ``end``."""
    w = in_order("pos")
    r = islands(rows.withColumn("_flag", flag).withColumn("_next", F.coalesce(F.lead("pts").over(w), F.col("end"))), F.col("_flag"))
    runs = r.where("_flag").groupBy("video_id", "island").agg(F.min("pts").alias("start"), F.max("_next").alias("end"), F.count("*").alias("n"))
    return runs.where(F.col("end") - F.col("start") >= min_ns).select("video_id", "start", "end", "n")


def sessions(rows: DataFrame, member: Column, gap: int) -> DataFrame:
    """Members in sessions that break at a row that is none or after a gap over ``gap``."""
    w = in_order("pos")
    r = rows.withColumn("_in", member).withColumn("_break", F.when(F.lag("_in").over(w) & (F.col("pts") - F.lag("pts").over(w) <= gap), 0).otherwise(1))
    r = r.where("_in").withColumn("session", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy("video_id", "session").agg(F.min("pts").alias("start"), F.max("pts").alias("end"), F.count("*").alias("n"), F.max("value").alias("worst"))


def asof_forward(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """left (video_id, t) with the first ``value`` of right (video_id, pts) at or after t; unmatched rows are dropped. One sort, no nested loop."""
    u = left.select("video_id", "t", F.lit(0).alias("side"), F.lit(None).cast("long").alias("v")).unionByName(right.select("video_id", F.col("pts").alias("t"), F.lit(1).alias("side"), F.col(value).cast("long").alias("v")))
    w = Window.partitionBy("video_id").orderBy("t", "side", "v").rowsBetween(0, Window.unboundedFollowing)
    return u.withColumn("match", F.first("v", ignorenulls=True).over(w)).where("side = 0 AND match IS NOT NULL").select("video_id", "t", "match")


def asof_nearest(left: DataFrame, right: DataFrame, value: str, tolerance: int) -> DataFrame:
    """left (video_id, t) with the nearest row of right within the tolerance; the later of two equally near."""
    s = F.struct("pts", F.col(value).cast("long").alias("v"))
    u = left.select("video_id", "t", F.lit(1).alias("side"), F.lit(None).cast("struct<pts:bigint,v:bigint>").alias("r")).unionByName(right.select("video_id", F.col("pts").alias("t"), F.lit(0).alias("side"), s.cast("struct<pts:bigint,v:bigint>").alias("r")))
    w = Window.partitionBy("video_id").orderBy("t", "side", "r")
    u = u.withColumn("p", F.last("r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.first("r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    dp, dn = F.coalesce(F.col("t") - F.col("p.pts"), F.lit(2**62)), F.coalesce(F.col("n.pts") - F.col("t"), F.lit(2**62))
    return u.where("side = 1").withColumn("m", F.when(dp < dn, F.col("p")).otherwise(F.col("n"))).where(F.least(dp, dn) <= tolerance).select("video_id", "t", F.col("m.v").alias("match"), F.least(dp, dn).alias("distance"))


def overlap_join(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Pairs of half-open intervals (video_id, id, start, end) that overlap, with the overlap; both sides are dealt into time cells of
    ``width``, so the join is on equal keys, and a pair counts in the first cell it shares."""
    cells = lambda d, p: d.where("start < end").select("video_id", F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("cell"))
    j = cells(a, "a").join(cells(b, "b"), ["video_id", "cell"]).where("a_start < b_end AND b_start < a_end")
    first = F.floor(F.greatest("a_start", "b_start") / width)
    return j.where(F.col("cell") == first).select("video_id", "a_id", "b_id", (F.least("a_end", "b_end") - F.greatest("a_start", "b_start")).alias("overlap"))


def interpolated(rows: DataFrame, value: Column) -> DataFrame:
    """Nulls of a value filled in a line between neighbours, at the ends with the nearest."""
    w = in_order("pos")
    r = rows.withColumn("_v", value).withColumn("_i", F.row_number().over(w))
    known = F.when(F.col("_v").isNotNull(), F.struct("_i", "_v"))
    r = r.withColumn("_p", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    line = F.col("_p._v") + (F.col("_n._v") - F.col("_p._v")) * (F.col("_i") - F.col("_p._i")) / (F.col("_n._i") - F.col("_p._i"))
    return r.withColumn("filled", F.coalesce(F.col("_v"), line, F.col("_p._v"), F.col("_n._v"))).drop("_v", "_i", "_p", "_n")


def moving_average(rows: DataFrame, value: str, half: int) -> DataFrame:
    """Centred; at the ends over the rows there are."""
    return rows.withColumn("smooth", F.avg(value).over(in_order("pos").rowsBetween(-half, half)))


def local_trend(rows: DataFrame, value: str, half: int) -> DataFrame:
    """The least-squares line over up to 2 * half + 1 rows, at the centre."""
    w = in_order("pos")
    r = rows.withColumn("_i", F.row_number().over(w).cast("double"))
    b = w.rowsBetween(-half, half)
    n, si, sv = F.count("*").over(b), F.sum("_i").over(b), F.sum(value).over(b)
    siv, sii = F.sum(F.col("_i") * F.col(value)).over(b), F.sum(F.col("_i") * F.col("_i")).over(b)
    det = n * sii - si * si
    slope = F.when(det != 0, (n * siv - si * sv) / det).otherwise(0.0)
    return r.withColumn("trend", sv / n + slope * (F.col("_i") - si / n)).drop("_i")


def scene_cuts(scores: DataFrame, threshold: float = 12.0, ratio: float = 3.0, min_gap: int = NS // 2) -> DataFrame:
    """Frames whose score is a peak: at the threshold, at ``ratio`` times the mean of the two neighbours on each side (frame 0 isn't one), and ``min_gap``
    after the last cut taken. The greedy step folds each video's few candidates in one array."""
    w = in_order("pos")
    near = w.rowsBetween(-2, 2)
    r = scores.withColumn("_i", F.row_number().over(w) - 1)
    counted = F.when(F.col("_i") > 0, F.col("score"))
    mean = (F.sum(counted).over(near) - F.col("score")) / F.nullif(F.count(counted).over(near) - 1, F.lit(0))
    c = r.withColumn("_m", F.coalesce(mean, F.lit(0.0))).where((F.col("_i") > 0) & (F.col("score") >= threshold) & (F.col("score") >= ratio * F.col("_m")))
    start = scores.groupBy("video_id").agg(F.min("pts").alias("first"))
    g = c.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("pts", "pos"))).alias("c")).join(start, "video_id")
    zero = F.struct(F.col("first").alias("last"), F.array().cast("array<struct<pts:bigint,pos:bigint>>").alias("cuts"))
    take = lambda a, x: F.when(x["pts"] - a["last"] >= min_gap, F.struct(x["pts"].alias("last"), F.concat(a["cuts"], F.array(x)).alias("cuts"))).otherwise(a)
    return g.select("video_id", F.explode(F.aggregate("c", zero, take)["cuts"]).alias("x")).select("video_id", F.col("x.pts").alias("pts"), F.col("x.pos").alias("pos"))


def shots(cuts: DataFrame, ends: DataFrame) -> DataFrame:
    """video_id, shot, start, end from cuts (video_id, pts) and each video's start and end."""
    s = cuts.select("video_id", F.col("pts").alias("start")).union(ends.select("video_id", "start")).distinct()
    w = Window.partitionBy("video_id").orderBy("start")
    s = s.join(ends.select("video_id", F.col("end").alias("_end")), "video_id")
    return s.select("video_id", (F.row_number().over(w) - 1).alias("shot"), "start", F.coalesce(F.lead("start").over(w), F.col("_end")).alias("end"))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with their index (from 0) in a video; two streams are paired by an inner join on it, which ends with the shorter."""
    return rows.withColumn("idx", (F.row_number().over(in_order("pos")) - 1).cast("long"))


def with_shot(rows: DataFrame, shot: DataFrame) -> DataFrame:
    """rows with the shot (and its start, ``shot_start``) that holds them: one sort of both, no range join."""
    s = F.struct(F.col("shot").cast("long").alias("shot"), F.col("start").cast("long").alias("start"))
    marks = shot.select("video_id", F.col("start").alias("pts"), s.alias("_s"))
    u = rows.withColumn("_side", F.lit(1)).unionByName(marks.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = in_order("_side", "pos").rowsBetween(Window.unboundedPreceding, 0)
    held = u.withColumn("_s", F.last("_s", ignorenulls=True).over(w)).where("_side = 1")
    return held.select(*rows.columns, F.col("_s.shot").alias("shot"), F.col("_s.start").alias("shot_start"))


def in_ranges(points: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """Every point (video_id, pts) with every half-open range (video_id, start, end) that holds it; ranges are dealt into time cells of ``width``."""
    cells = ranges.where("start < end").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    return points.withColumn("_cell", F.floor(F.col("pts") / width)).join(cells, ["video_id", "_cell"]).where("pts >= start AND pts < end").drop("_cell")


def shake(rows: DataFrame, dx: str, dy: str, half: int) -> DataFrame:
    """How far the summed movement lies from its own local trend."""
    run = in_order("pos").rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumns({"_x": F.sum(dx).over(run), "_y": F.sum(dy).over(run)})
    r = local_trend(local_trend(r, "_x", half).withColumnRenamed("trend", "_tx"), "_y", half)
    return r.withColumn("shake", F.hypot(F.col("_x") - F.col("_tx"), F.col("_y") - F.col("trend"))).drop("_x", "_y", "_tx", "trend")


def pieces(keys: DataFrame, ends: DataFrame, least: int) -> DataFrame:
    """video_id, piece, start, end: from each kept key time to the first key time ``least`` later; a tail shorter than that joins the piece before.
    The fold holds one video's key times."""
    g = keys.groupBy("video_id").agg(F.array_sort(F.collect_set("pts")).alias("k"))
    g = ends.join(g, "video_id", "left").withColumn("k", F.coalesce("k", F.array().cast("array<bigint>")))
    take = lambda a, x: F.when(x - F.element_at(a, -1) >= least, F.concat(a, F.array(x))).otherwise(a)
    g = g.withColumn("b", F.aggregate("k", F.array(F.col("start").cast("long")), take))
    short = (F.size("b") > 1) & (F.col("end") - F.element_at("b", -1) < least)
    g = g.withColumn("b", F.when(short, F.slice("b", F.lit(1), F.size("b") - 1)).otherwise(F.col("b")))
    p = g.select("video_id", "end", "b", F.posexplode("b").alias("piece", "start"))
    return p.select("video_id", "piece", "start", F.coalesce(F.get("b", F.col("piece") + 1), F.col("end")).alias("end"))


def keyframe_splits(rows: DataFrame, count: int, gap: int) -> DataFrame:
    """video_id, part, first: up to ``count`` runs of frames of about one size, each from a key frame. Each ideal bound moves on to the next key frame, and
    is kept if it lies ``gap`` frames after the last kept bound and before the end."""
    n = numbered(rows)
    ahead = in_order("pos").rowsBetween(0, Window.unboundedFollowing)
    n = n.withColumn("_key", F.min(F.when(F.col("key"), F.col("idx"))).over(ahead)).withColumn("_n", F.count("*").over(Window.partitionBy("video_id")))
    bounds = F.transform(F.sequence(F.lit(1), F.lit(count - 1)), lambda i: F.floor(i * F.col("_n") / count))
    at = n.where(F.array_contains(bounds, F.col("idx")))
    g = at.where("_key IS NOT NULL").groupBy("video_id").agg(F.array_sort(F.collect_set("_key")).alias("k"))
    g = n.groupBy("video_id").agg(F.max("_n").alias("_n")).join(g, "video_id", "left").withColumn("k", F.coalesce("k", F.array().cast("array<bigint>")))
    take = lambda a, x: F.when((x - F.element_at(a, -1) >= gap) & (F.col("_n") - x >= gap), F.concat(a, F.array(x))).otherwise(a)
    return g.select("video_id", F.posexplode(F.aggregate("k", F.array(F.lit(0).cast("long")), take)).alias("part", "first"))
