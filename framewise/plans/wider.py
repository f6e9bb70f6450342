"""More registered queries: pairings, plans, statistics of frames and titles, rules. See registry.py for the common tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import findings, seq, shares
from . import tables as t
from .registry import E, EST, P, RUN, S, SHOTS, query, r6, shots


def for_video() -> Window:
    return Window.partitionBy("video_id")


def framed(p: DataFrame) -> DataFrame:
    return seq.with_shot(t.with_end(p), shots(t.with_end(p)))


IN_SHOT = ", f AS (SELECT e.*, sh.id AS shot, sh.start FROM e JOIN sh ON e.video_id = sh.video_id AND e.pts >= sh.start AND e.pts < sh.fin)"


# ---- pairings -------------------------------------------------------------------------------------------------
@query("j1_packet_frames", f"""WITH {P}, a AS (SELECT video_id, pos, size, row_number() OVER (PARTITION BY video_id ORDER BY pts, pos) - 1 AS idx FROM p), b AS (SELECT video_id, value AS si, row_number() OVER (PARTITION BY video_id ORDER BY pts, pos) - 1 AS idx FROM p WHERE event_type <> 'error')
SELECT video_id, idx, pos, size, si FROM a LEFT JOIN b USING (video_id, idx)""")
def j1(spark, sf):
    p = t.packets(spark, sf)
    frames = seq.numbered(p.where("event_type <> 'error'")).select("video_id", "idx", F.col("value").alias("si"))
    return seq.numbered(p).join(frames, ["video_id", "idx"], "left").select("video_id", "idx", "pos", "size", "si")


@query("j2_paired_frames", f"""WITH {P}, a AS (SELECT video_id, pos % 2 AS side, pos, value, row_number() OVER (PARTITION BY video_id, pos % 2 ORDER BY pts, pos) - 1 AS idx FROM p)
SELECT r.video_id, r.idx, r.pos AS reference, d.pos AS distorted, round(abs(r.value - d.value), 6) AS difference FROM a r JOIN a d ON r.video_id = d.video_id AND r.idx = d.idx AND r.side = 0 AND d.side = 1""")
def j2(spark, sf):
    p = t.packets(spark, sf)
    r = seq.numbered(p.where("pos % 2 = 0")).select("video_id", "idx", F.col("pos").alias("reference"), F.col("value").alias("x"))
    d = seq.numbered(p.where("pos % 2 = 1")).select("video_id", "idx", F.col("pos").alias("distorted"), F.col("value").alias("y"))
    return r.join(d, ["video_id", "idx"]).select("video_id", "idx", "reference", "distorted", r6(F.abs(F.col("x") - F.col("y")), "difference"))


@query("j6_active_clips", f"WITH {P}, c AS (SELECT video_id, pos AS clip, pts - 21600000000000 AS warm, pts, pts + 43200000000000 AS fin FROM p WHERE key) SELECT p.video_id, p.pos, clip, p.pts < c.pts AS warming FROM p JOIN c ON p.video_id = c.video_id AND p.pts >= warm AND p.pts < fin")
def j6(spark, sf):
    p = t.packets(spark, sf)
    c = p.where("key").select("video_id", F.col("pos").alias("clip"), F.col("pts").alias("begin"), (F.col("pts") - 6 * t.HOUR).alias("start"), (F.col("pts") + 12 * t.HOUR).alias("end"))
    return seq.in_ranges(p.select("video_id", "pos", "pts"), c, t.DAY).select("video_id", "pos", "clip", (F.col("pts") < F.col("begin")).alias("warming"))


@query("j8_sliced_events", f"""WITH {P}, w AS (SELECT DISTINCT video_id, pts // 864000000000000 AS slice FROM p), ev AS (SELECT video_id, pos, pts AS a, pts + CAST(size AS BIGINT) * 60000000000 AS b FROM p WHERE size > 0)
SELECT ev.video_id, pos, slice, greatest(a, slice * 864000000000000) - slice * 864000000000000 AS start, least(b, (slice + 1) * 864000000000000) - slice * 864000000000000 AS "end" FROM ev JOIN w ON ev.video_id = w.video_id AND a < (slice + 1) * 864000000000000 AND b > slice * 864000000000000""")
def j8(spark, sf):
    p, ten = t.packets(spark, sf), 10 * t.DAY
    windows = p.select("video_id", F.expr(f"pts div {ten}").alias("slice")).distinct()
    events = p.where("size > 0").select("video_id", "pos", F.col("pts").alias("a"), (F.col("pts") + F.col("size") * 60_000_000_000).alias("b"))
    cells = events.withColumn("slice", F.explode(F.sequence(F.expr(f"a div {ten}"), F.expr(f"(b - 1) div {ten}"))))
    at = F.col("slice") * ten
    return cells.join(windows, ["video_id", "slice"]).select("video_id", "pos", "slice", (F.greatest("a", at) - at).alias("start"), (F.least("b", at + ten) - at).alias("end"))


@query("j19_common_features", "WITH x AS (SELECT DISTINCT l_suppkey AS title, l_returnflag AS name FROM lineitem) SELECT name, count(*) AS titles FROM x GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT title) FROM x)")
def j19(spark, sf):
    x = t.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("title"), F.col("l_returnflag").alias("name")).distinct()
    n = x.agg(F.count_distinct("title").alias("n"))
    return x.groupBy("name").agg(F.count("*").alias("titles")).join(F.broadcast(n), F.col("titles") == F.col("n")).select("name", "titles")


# ---- windows --------------------------------------------------------------------------------------------------
@query("w4_centred_rate", f"WITH {P} SELECT video_id, pos, CAST(round(sum(size) OVER (PARTITION BY video_id ORDER BY pts RANGE BETWEEN 43200000000000 PRECEDING AND 43199999999999 FOLLOWING) * 8 / 86400.0) AS BIGINT) AS bitrate FROM p")
def w4(spark, sf):
    w = Window.partitionBy("video_id").orderBy("pts").rangeBetween(-t.DAY // 2, t.DAY // 2 - 1)
    return t.packets(spark, sf).select("video_id", "pos", F.round(F.sum("size").over(w) * 8 / 86400.0).cast("long").alias("bitrate"))


PATH = """, q AS (SELECT video_id, pos, pts, row_number() OVER w AS i, sum(value - 50) OVER w AS x, sum((size % 7 - 3)::DOUBLE) OVER w AS y FROM p WINDOW w AS (PARTITION BY video_id ORDER BY pts, pos)),
z AS (SELECT *, regr_slope(x, i) OVER b AS sx, regr_slope(y, i) OVER b AS sy, avg(x) OVER b AS ax, avg(y) OVER b AS ay, avg(i) OVER b AS ai FROM q WINDOW b AS (PARTITION BY video_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))"""


@query("w14_shake", f"WITH {P}{PATH} SELECT video_id, pos, round(sqrt(pow(x - ax - coalesce(CASE WHEN isnan(sx) THEN 0 ELSE sx END, 0) * (i - ai), 2) + pow(y - ay - coalesce(CASE WHEN isnan(sy) THEN 0 ELSE sy END, 0) * (i - ai), 2)), 4) AS shake FROM z")
def w14(spark, sf):
    p = t.packets(spark, sf).withColumns({"dx": F.col("value") - 50, "dy": (F.col("size") % 7 - 3).cast("double")})
    return seq.shake(p, "dx", "dy", 3).select("video_id", "pos", r6("shake", "shake", 4))


SILENT = """, x AS (SELECT *, abs(l) < 25 AND abs(r) < 25 AS f, coalesce(lead(pts) OVER w, "end") AS nx, row_number() OVER w - row_number() OVER (PARTITION BY video_id, abs(l) < 25 AND abs(r) < 25 ORDER BY pts, pos) AS g, min(pts) OVER (PARTITION BY video_id) AS a0 FROM s WINDOW w AS (PARTITION BY video_id ORDER BY pts, pos))"""


@query("w18_silence_runs", f"""WITH {E}, s AS (SELECT *, value - 50 AS l, CASE WHEN event_type = 'error' THEN 50 - value ELSE value - 40 END AS r FROM e){SILENT}
SELECT video_id, min(pts) AS start, max(nx) AS "end", CASE WHEN min(pts) = min(a0) THEN 'leading' WHEN max(nx) = min("end") THEN 'trailing' ELSE 'inner' END AS place FROM x WHERE f GROUP BY video_id, g""")
def w18(spark, sf):
    p = t.with_end(t.steps(spark, sf))
    runs = seq.flag_runs(p, (F.abs("left") < 25) & (F.abs("right") < 25))
    ends = p.groupBy("video_id").agg(F.min("pts").alias("first"), F.max("end").alias("last"))
    place = F.when(F.col("start") == F.col("first"), "leading").when(F.col("end") == F.col("last"), "trailing").otherwise("inner")
    return runs.join(ends, "video_id").select("video_id", "start", "end", place.alias("place"))


@query("w20_over_runs", f"""WITH {E}{RUN.replace("value < 30", "value > 90")} SELECT video_id, min(pts) AS start, max(nx) AS "end", max(value) AS worst FROM x WHERE f GROUP BY video_id, g""")
def w20(spark, sf):
    w = seq.in_order("pos")
    r = seq.islands(t.with_end(t.packets(spark, sf)).withColumns({"over": F.col("value") > 90, "nx": F.coalesce(F.lead("pts").over(w), F.col("end"))}), F.col("over"))
    return r.where("over").groupBy("video_id", "island").agg(F.min("pts").alias("start"), F.max("nx").alias("end"), F.max("value").alias("worst")).drop("island")


@query("w24_pieces")
def w24(spark, sf):
    p = t.with_end(t.packets(spark, sf))
    ends = p.groupBy("video_id").agg(F.min("pts").alias("start"), F.max("end").alias("end"))
    return seq.pieces(p.where("key").select("video_id", "pts"), ends, 2 * t.DAY)


@query("w25_keyframe_splits")
def w25(spark, sf):
    return seq.keyframe_splits(t.packets(spark, sf), 6, 3)


@query("w27_improving_points", "WITH x AS (SELECT o_custkey AS title, o_orderkey AS point, o_totalprice AS vmaf, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM orders) SELECT title, point, vmaf FROM x WHERE best IS NULL OR vmaf > best")
def w27(spark, sf):
    w = Window.partitionBy("title").orderBy("point").rowsBetween(Window.unboundedPreceding, -1)
    o = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("title"), F.col("o_orderkey").alias("point"), F.col("o_totalprice").alias("vmaf"))
    return o.withColumn("best", F.max("vmaf").over(w)).where("best IS NULL OR vmaf > best").select("title", "point", "vmaf")


@query("w30_merged_segments", "SELECT l_suppkey AS video_id, l_partkey AS idx, l_orderkey AS run, l_linenumber AS line FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) = 1")
def w30(spark, sf):
    li = t.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("video_id"), F.col("l_partkey").alias("idx"), F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("line"))
    return li.groupBy("video_id", "idx").agg(F.min(F.struct("run", "line")).alias("m")).select("video_id", "idx", "m.run", "m.line")


# ---- statistics -----------------------------------------------------------------------------------------------
@query("a10_crop_union", f"WITH {P} SELECT video_id, CAST(min(size % 90) // 2 * 2 AS BIGINT) AS x0, CAST(min(size % 50) // 2 * 2 AS BIGINT) AS y0, CAST((max(1900 + size % 21) + 1) // 2 * 2 AS BIGINT) AS x1, CAST((max(1060 + size % 21) + 1) // 2 * 2 AS BIGINT) AS y1 FROM p WHERE value >= 5 GROUP BY 1")
def a10(spark, sf):
    s = F.col("size")
    return shares.box_union(t.packets(spark, sf).where("value >= 5").withColumns({"x0": s % 90, "y0": s % 50, "x1": 1900 + s % 21, "y1": 1060 + s % 21}))


@query("a11_light", f"""WITH {P}, x AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY value DESC, pts, pos) AS a, row_number() OVER (PARTITION BY video_id ORDER BY size % 400 DESC, pts, pos) AS b FROM p)
SELECT video_id, max(value) AS max_cll, max(CASE WHEN a = 1 THEN pos END) AS cll_pos, max(size % 400) AS max_fall, max(CASE WHEN b = 1 THEN pos END) AS fall_pos FROM x GROUP BY 1""")
def a11(spark, sf):
    first = lambda c: F.min_by("pos", F.struct((-c).alias("c"), "pts", "pos"))
    v, f = F.col("value"), F.col("size") % 400
    return t.packets(spark, sf).groupBy("video_id").agg(F.max(v).alias("max_cll"), first(v).alias("cll_pos"), F.max(f).alias("max_fall"), first(f).alias("fall_pos"))


@query("a16_channel_stats", f"WITH {S} SELECT video_id, round(avg(l), 6) AS dc, round(sqrt(avg(l * l)), 6) AS rms, max(abs(l)) AS peak, count(*) FILTER (abs(l) >= 49) AS clipped, round(avg(CASE WHEN abs(l) < 1 THEN 1.0 ELSE 0 END), 6) AS silent, count(*) FILTER (abs(l) < 1 AND abs(r) >= 1) >= 0.99 * count(*) FILTER (abs(r) >= 1) AND count(*) FILTER (abs(r) >= 1) > 0 AS muted FROM s GROUP BY 1")
def a16(spark, sf):
    return shares.channel_stats(t.steps(spark, sf), "left", "right", clip=49.0, silence=1.0)


@query("a22_collapsed", f"""WITH {EST}, o AS (SELECT video_id, stratum, w, m, slots, row_number() OVER (PARTITION BY video_id ORDER BY stratum) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS c FROM x WHERE slots > 1),
g AS (SELECT *, least(i // 2, c // 2 - 1) AS g FROM o WHERE c >= 2), h AS (SELECT *, sum(w * m) OVER q / sum(w) OVER q AS mid, count(*) OVER q AS k FROM g WINDOW q AS (PARTITION BY video_id, g))
SELECT video_id, round(sum(k / (k - 1) * (1 - 1.0 / slots) * w * w * (m - mid) * (m - mid)), 6) AS variance, max(c) - max(c) // 2 AS df FROM h GROUP BY 1""")
def a22(spark, sf):
    c = t.clips(spark, sf)
    one = c.where("scored").groupBy("video_id", "stratum").agg((F.sum(F.col("mean") * F.col("frames")) / F.sum("frames")).alias("m"))
    s = one.join(t.strata(c), ["video_id", "stratum"]).withColumn("w", F.col("frames") / F.sum("frames").over(for_video()))
    return shares.collapsed_variance(s).select("video_id", r6("variance", "variance"), "df")


@query("a25_banding", f"""WITH {P}, x AS (SELECT *, value > 25 AS m, lag(value > 25) OVER w AS lm, pts - lag(pts) OVER w AS d FROM p WINDOW w AS (PARTITION BY video_id ORDER BY pts, pos))
SELECT video_id, round(avg(CASE WHEN m THEN 1.0 ELSE 0 END), 6) AS banded, round(count(*) FILTER (m AND key) / nullif(count(*) FILTER (m), 0), 6) AS inherited, count(*) FILTER (m AND NOT coalesce(lm AND d <= 43200000000000, false)) AS segments FROM x GROUP BY 1""")
def a25(spark, sf):
    return shares.banding(t.packets(spark, sf).withColumns({"banded": F.col("value") > 25, "source": F.col("key")}), 12 * t.HOUR)


@query("a26_segment_means", f"""WITH {P}, x AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pts, pos) - 1 AS i FROM p)
SELECT video_id, i // 10 AS segment, round(avg(value), 6) AS plain, round(avg(ln(1 + value)), 6) AS log, round(avg(CASE WHEN i > 0 THEN abs(value - 50) END), 6) AS temporal FROM x GROUP BY ALL""")
def a26(spark, sf):
    f = seq.numbered(t.packets(spark, sf))
    v = F.col("value")
    return f.groupBy("video_id", F.expr("idx div 10").alias("segment")).agg(r6(F.avg(v), "plain"), r6(F.avg(F.log1p(v)), "log"), r6(F.avg(F.when(F.col("idx") > 0, F.abs(v - 50))), "temporal"))


@query("a28_interval_means", f"WITH {P}, x AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pts, pos) - 1 AS i FROM p), d AS (SELECT video_id, unnest(range(0, greatest(max(i) - 3, 1))) AS first FROM x GROUP BY 1) SELECT d.video_id, first, round(avg(value), 6) AS mean FROM d JOIN x ON d.video_id = x.video_id AND i BETWEEN first AND first + 4 GROUP BY ALL")
def a28(spark, sf):
    f = seq.numbered(t.packets(spark, sf)).withColumn("n", F.count("*").over(for_video()))
    w = Window.partitionBy("video_id").orderBy("idx").rowsBetween(0, 4)
    return f.withColumn("mean", F.avg("value").over(w)).where("idx < greatest(n - 4, 1)").select("video_id", F.col("idx").alias("first"), r6("mean", "mean"))


@query("a29_class_shares", f"""WITH {E}{SHOTS}{IN_SHOT}, kk AS (SELECT video_id, shot, min(start) AS start, CASE WHEN avg(value) < 40 THEN 'static' WHEN avg(value) < 60 THEN 'pan' ELSE 'shaky' END AS class, count(*) AS frames FROM f GROUP BY video_id, shot)
SELECT video_id, class, count(*) AS shots, CAST(sum(frames) AS BIGINT) AS frames, round(sum(frames) / sum(sum(frames)) OVER (PARTITION BY video_id), 6) AS share, row_number() OVER (PARTITION BY video_id ORDER BY sum(frames) DESC, min(start)) AS place FROM kk GROUP BY video_id, class""")
def a29(spark, sf):
    mean = F.avg("value")
    kind = F.when(mean < 40, "static").when(mean < 60, "pan").otherwise("shaky")
    return shares.class_shares(framed(t.packets(spark, sf)).groupBy("video_id", "shot").agg(F.min("shot_start").alias("start"), kind.alias("class"), F.count("*").alias("frames")))


@query("a30_dominant_move", f"WITH {E}{SHOTS}{IN_SHOT} SELECT video_id, shot, event_type AS move, count(*) AS frames FROM f GROUP BY video_id, shot, event_type QUALIFY row_number() OVER (PARTITION BY video_id, shot ORDER BY count(*) DESC, event_type) = 1")
def a30(spark, sf):
    n = framed(t.packets(spark, sf)).groupBy("video_id", "shot", "event_type").agg(F.count("*").alias("frames"))
    best = n.groupBy("video_id", "shot").agg(F.min(F.struct((-F.col("frames")).alias("k"), F.col("event_type").alias("move"))).alias("m"))
    return best.select("video_id", "shot", "m.move", (-F.col("m.k")).alias("frames"))


@query("a32_energy", "SELECT l_suppkey AS title, round(sum(l_quantity * l_extendedprice) / 3600000, 6) AS kwh, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity * l_discount ELSE 0 END), 4) AS saved, round(avg(l_quantity), 6) AS cost FROM lineitem GROUP BY 1")
def a32(spark, sf):
    q = F.col("l_quantity").cast("double")
    return t.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("title")).agg(r6(F.sum(q * F.col("l_extendedprice")) / 3600000, "kwh"), r6(F.sum(F.when(F.col("l_returnflag") == "R", q * F.col("l_discount")).otherwise(0.0)), "saved", 4), r6(F.avg(q), "cost"))


@query("a34_validation_errors", "WITH e AS (SELECT l_linenumber AS point, l_suppkey AS title, l_tax * 100 - l_discount * 100 AS err FROM lineitem) SELECT point, count(DISTINCT title) AS titles, round(avg(abs(err)), 6) AS mean, round(quantile_disc(abs(round(err, 6)), 0.95), 6) AS p95, round(max(abs(err)), 6) AS worst FROM e GROUP BY 1")
def a34(spark, sf):
    e = t.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("point"), F.col("l_suppkey").alias("title"), F.round(F.abs(F.col("l_tax") * 100 - F.col("l_discount") * 100), 6).cast("double").alias("err"))
    return shares.validation_errors(e)


@query("a35_coverage", "WITH r AS (SELECT l_suppkey AS design, l_extendedprice / 1000 - 35 AS error, l_quantity AS half, l_linenumber > 5 AS fallback FROM lineitem) SELECT design, count(*) AS runs, round(avg(CASE WHEN abs(error) <= half THEN 1.0 ELSE 0 END), 6) AS coverage, round(sqrt(avg(error * error)), 6) AS rmse, round(avg(half), 6) AS half_width, count(*) FILTER (fallback) AS fallbacks FROM r GROUP BY 1")
def a35(spark, sf):
    r = t.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("design"), (F.col("l_extendedprice") / 1000 - 35).cast("double").alias("error"), F.col("l_quantity").cast("double").alias("half"), (F.col("l_linenumber") > 5).alias("fallback"))
    return shares.coverage(r)


@query("a36_program_complexity", "SELECT o_custkey AS program, CASE WHEN count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) < count(*) THEN NULL ELSE round(avg(o_totalprice), 4) END AS complexity FROM orders GROUP BY 1")
def a36(spark, sf):
    c = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return t.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("program")).agg(F.when(F.count(c) == F.count("*"), F.round(F.avg(c), 4)).alias("complexity"))


@query("a39_title_spread", "SELECT l_linenumber AS rung, arg_max(title, (vmaf, -title)) AS best, arg_min(title, (vmaf, title)) AS worst, round(max(vmaf) - min(vmaf), 4) AS spread FROM (SELECT l_linenumber, l_suppkey AS title, max(l_extendedprice) AS vmaf FROM lineitem GROUP BY ALL) GROUP BY 1")
def a39(spark, sf):
    v = t.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("rung"), F.col("l_suppkey").alias("title")).agg(F.max("l_extendedprice").alias("vmaf"))
    return v.groupBy("rung").agg(F.max_by("title", F.struct("vmaf", -F.col("title"))).alias("best"), F.min_by("title", F.struct("vmaf", "title")).alias("worst"), F.round(F.max("vmaf") - F.min("vmaf"), 4).alias("spread"))


@query("a40_residual_correlation", f"WITH {S} SELECT video_id, round(sum(l * r) / nullif(sum(l * l), 0), 6) AS correlation FROM s GROUP BY 1")
def a40(spark, sf):
    l, r = F.col("left"), F.col("right")  # noqa: E741
    return t.steps(spark, sf).groupBy("video_id").agg(r6(F.sum(l * r) / F.nullif(F.sum(l * l), F.lit(0.0)), "correlation"))


# ---- picks ----------------------------------------------------------------------------------------------------
@query("t11_even_clips", "WITH g AS (SELECT o_custkey AS scene, count(*) AS slots FROM orders GROUP BY 1), c AS (SELECT *, least(3, slots) AS n FROM g) SELECT scene, CAST(k AS INT) AS k, (2 * k + 1) * slots // (2 * n) AS slot FROM c, LATERAL (SELECT unnest(range(0, n)) AS k)")
def t11(spark, sf):
    g = t.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("scene")).agg(F.count("*").alias("slots"))
    c = g.withColumn("n", F.least(F.lit(3), "slots")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return c.select("scene", F.col("k").cast("int").alias("k"), F.expr("(2 * k + 1) * slots div (2 * n)").alias("slot"))


@query("t13_worst_frame", f"WITH {P} SELECT video_id, min_by(pos, (value, pts, pos)) AS pos, min(value) AS value FROM p GROUP BY 1")
def t13(spark, sf):
    return t.packets(spark, sf).groupBy("video_id").agg(F.min_by("pos", F.struct("value", "pts", "pos")).alias("pos"), F.min("value").alias("value"))


@query("t14_chart_buckets", f"WITH {P}, x AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pts, pos) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS c FROM p) SELECT video_id, i * least(c, 8) // c AS bucket, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM x GROUP BY ALL")
def t14(spark, sf):
    f = seq.numbered(t.packets(spark, sf)).withColumn("c", F.count("*").over(for_video()))
    return f.groupBy("video_id", F.expr("idx * least(c, 8) div c").alias("bucket")).agg(r6(F.avg("value"), "mean"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("t16_digest_draws", "WITH c AS (SELECT l_suppkey AS title, d, l_orderkey, l_linenumber, md5(d || ':' || l_orderkey || ':' || l_linenumber) AS h FROM lineitem, range(1, 7) r(d)), o AS (SELECT *, row_number() OVER (PARTITION BY title, d ORDER BY h) - 1 AS i FROM c) SELECT title, CAST(d AS INT) AS draw, i // 4 AS digest, l_orderkey, l_linenumber FROM o")
def t16(spark, sf):
    li = t.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("title"), "l_orderkey", "l_linenumber", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("draw"))
    w = Window.partitionBy("title", "draw").orderBy(F.md5(F.concat_ws(":", "draw", "l_orderkey", "l_linenumber")))
    return li.withColumn("i", F.row_number().over(w) - 1).select("title", "draw", F.expr("cast(i as bigint) div 4").alias("digest"), "l_orderkey", "l_linenumber")


@query("u1_boundaries", f"""WITH {P} SELECT video_id, pts FROM p WHERE key UNION SELECT video_id, pts FROM p WHERE value > 95""")
def u1(spark, sf):
    p = t.packets(spark, sf)
    return p.where("key").select("video_id", "pts").union(p.where("value > 95").select("video_id", "pts")).distinct()


# ---- supporting operators -------------------------------------------------------------------------------------
@query("x7_snapped_shots", f"WITH {P}, x AS (SELECT DISTINCT video_id, CAST(round(pts / 21600000000000.0) AS BIGINT) * 21600000000000 AS start FROM p WHERE key), z AS (SELECT video_id, min(pts) AS a, max(pts) AS b FROM p GROUP BY 1), k AS (SELECT video_id, start FROM x JOIN z USING (video_id) WHERE start > a AND start < b UNION SELECT video_id, a FROM z) SELECT video_id, start, coalesce(lead(start) OVER (PARTITION BY video_id ORDER BY start), b) AS next FROM k JOIN z USING (video_id)")
def x7(spark, sf):
    p, gop = t.packets(spark, sf), 6 * t.HOUR
    z = p.groupBy("video_id").agg(F.min("pts").alias("a"), F.max("pts").alias("b"))
    cuts = p.where("key").select("video_id", (F.round(F.col("pts") / float(gop)).cast("long") * gop).alias("start")).join(z, "video_id").where("start > a AND start < b")
    k = cuts.select("video_id", "start").union(z.select("video_id", "a")).distinct()
    k = k.withColumn("next", F.lead("start").over(Window.partitionBy("video_id").orderBy("start")))
    return k.join(z, "video_id").select("video_id", "start", F.coalesce("next", "b").alias("next"))


@query("x15_pooled_rates", f"WITH {P} SELECT video_id, round(coalesce(sum(value * (size % 5)) / nullif(sum(size % 5), 0), 0), 6) AS rate FROM p GROUP BY 1")
def x15(spark, sf):
    n = F.col("size") % 5
    return t.packets(spark, sf).groupBy("video_id").agg(r6(F.coalesce(F.sum(F.col("value") * n) / F.nullif(F.sum(n), F.lit(0)), F.lit(0.0)), "rate"))


@query("x16_merged_chunks", f"WITH {P}, x AS (SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY video_id, event_type ORDER BY pts, pos) AS g FROM p WINDOW w AS (PARTITION BY video_id ORDER BY pts, pos)) SELECT video_id, min(pts) AS start, event_type AS setting, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS frames FROM x GROUP BY video_id, event_type, g")
def x16(spark, sf):
    r = seq.islands(t.packets(spark, sf), F.col("event_type"))
    return r.groupBy("video_id", "island").agg(F.min("pts").alias("start"), F.first("event_type").alias("setting"), F.count("*").alias("chunks"), F.sum("size").alias("frames")).drop("island")


@query("x18_shot_measures", f"WITH {E}{SHOTS}{IN_SHOT} SELECT video_id, shot, CAST(sum(size) AS BIGINT) AS bytes, round(avg(CASE WHEN event_type = 'view' THEN value END), 6) AS vmaf FROM f GROUP BY video_id, shot")
def x18(spark, sf):
    return framed(t.packets(spark, sf)).groupBy("video_id", "shot").agg(F.sum("size").alias("bytes"), r6(F.avg(F.when(F.col("event_type") == "view", F.col("value"))), "vmaf"))


@query("x27_even_segments", "WITH d AS (SELECT o_orderkey AS title, CAST(floor(o_totalprice) AS BIGINT) * 1000000 AS dur FROM orders), c AS (SELECT *, CASE WHEN dur <= 60000000000 THEN 1 ELSE greatest(1, 60000000000 // 20000000000) END AS n FROM d) SELECT title, CAST(k AS INT) AS k, CASE WHEN dur <= 60000000000 THEN 0 ELSE (2 * k + 1) * dur // (2 * n) - 10000000000 END AS start, CASE WHEN dur <= 60000000000 THEN dur ELSE 20000000000 END AS length FROM c, LATERAL (SELECT unnest(range(0, n)) AS k)")
def x27(spark, sf):
    d = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("title"), (F.floor("o_totalprice").cast("long") * 1_000_000).alias("dur"))
    return shares.even_segments(d, 60 * fn.NS, 20 * fn.NS)


@query("x33_bad_timestamps", f"WITH {P}, x AS (SELECT *, lag(pts) OVER (PARTITION BY video_id ORDER BY pos) AS b FROM p) SELECT video_id, min_by(pos, pos) AS pos FROM x WHERE pts <= b GROUP BY 1")
def x33(spark, sf):
    w = Window.partitionBy("video_id").orderBy("pos")
    return t.packets(spark, sf).withColumn("b", F.lag("pts").over(w)).where("pts <= b").groupBy("video_id").agg(F.min("pos").alias("pos"))


@query("x35_badges", f"WITH {P}, f AS (SELECT video_id, pos, 1 AS flag FROM p WHERE key UNION ALL SELECT video_id, pos, 2 FROM p WHERE value > 60 UNION ALL SELECT video_id, pos, 3 FROM p WHERE size % 2 = 0) SELECT video_id, pos, CAST(row_number() OVER (PARTITION BY video_id, pos ORDER BY flag) AS INT) AS slot, flag FROM f")
def x35(spark, sf):
    flags = F.array(F.when(F.col("key"), 1), F.when(F.col("value") > 60, 2), F.when(F.col("size") % 2 == 0, 3))
    p = t.packets(spark, sf).select("video_id", "pos", F.posexplode(F.array_compact(flags)).alias("i", "flag"))
    return p.select("video_id", "pos", (F.col("i") + 1).alias("slot"), "flag")


@query("x36_flash_frames", f"WITH {E}{SHOTS}{IN_SHOT}, n AS (SELECT video_id, pos, shot, row_number() OVER (PARTITION BY video_id, shot ORDER BY pts, pos) - 1 AS i FROM f) SELECT video_id, pos, shot FROM n WHERE i < 2 AND shot > 0")
def x36(spark, sf):
    w = Window.partitionBy("video_id", "shot").orderBy("pts", "pos")
    return framed(t.packets(spark, sf)).withColumn("i", F.row_number().over(w) - 1).where("i < 2 AND shot > 0").select("video_id", "pos", "shot")


@query("x38_display_clock", f"WITH {P}, x AS (SELECT video_id, pos, pts - min(pts) OVER (PARTITION BY video_id) AS r, lag(pts) OVER w - min(pts) OVER (PARTITION BY video_id) AS b FROM p WINDOW w AS (PARTITION BY video_id ORDER BY pts, pos)) SELECT video_id, pos, (coalesce((r + b) // 2, 0) + 5000000) // 10000000 AS shown FROM x")
def x38(spark, sf):
    w = seq.in_order("pos")
    r = F.col("pts") - F.min("pts").over(for_video())
    x = t.packets(spark, sf).withColumn("r", r).withColumn("b", F.lag("r").over(w))
    return x.select("video_id", "pos", F.expr("(coalesce((r + b) div 2, 0) + 5000000) div 10000000").alias("shown"))


# ---- models ---------------------------------------------------------------------------------------------------
@query("m13_preset_transfer", "SELECT l_orderkey, l_linenumber, round(1.5 + (0.5 - 1.5) * (ln(h) - ln(360)) / (ln(1080) - ln(360)), 6) AS crf_offset, round(l_extendedprice * exp(0.1 + (0.3 - 0.1) * (ln(h) - ln(360)) / (ln(1080) - ln(360))), 4) AS rate FROM (SELECT *, 240 + l_linenumber * 120 AS h FROM lineitem)")
def m13(spark, sf):
    h = (240 + F.col("l_linenumber") * 120).cast("double")
    li = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("rate"), h.alias("height"))
    return shares.transfer(li, (360, 1.5, 0.1), (1080, 0.5, 0.3)).select("l_orderkey", "l_linenumber", r6("crf_offset", "crf_offset"), r6("rate", "rate", 4))


@query("m37_motion_classes", f"WITH {P} SELECT video_id, pos, CASE WHEN sqrt(x * x + y * y) < 5 THEN 'static' WHEN abs(x) >= 2 * abs(y) THEN CASE WHEN x > 0 THEN 'pan-right' ELSE 'pan-left' END WHEN abs(y) >= 2 * abs(x) THEN CASE WHEN y > 0 THEN 'tilt-down' ELSE 'tilt-up' END ELSE 'mixed' END AS move FROM (SELECT *, value - 50 AS x, (size % 41 - 20)::DOUBLE AS y FROM p)")
def m37(spark, sf):
    p = t.packets(spark, sf)
    return p.select("video_id", "pos", shares.move_class(F.col("value") - 50, (F.col("size") % 41 - 20).cast("double")).alias("move"))


# ---- rules ----------------------------------------------------------------------------------------------------
Q = "CAST(l_quantity AS DOUBLE)"
REPORTS = {  # lineitem's rows as report rows: a column for each a rule reads
    "video": f"l_orderkey * 8 + l_linenumber AS video_id, l_linenumber % 3 AS black, l_linenumber % 2 AS frozen, l_returnflag = 'R' AS letterbox, l_quantity > 45 AS pillarbox, CAST(l_discount AS DOUBLE) / 5 AS out_of_range, CASE WHEN l_linestatus = 'F' THEN l_linenumber ELSE 0 END AS shaky, {Q} / 8 AS worst_shake, CASE l_linenumber % 4 WHEN 0 THEN 'tt' WHEN 1 THEN '' ELSE 'progressive' END AS field_order",
    "audio": f"l_orderkey * 8 + l_linenumber AS video_id, CASE l_linenumber % 4 WHEN 0 THEN 22050 WHEN 1 THEN 44100 ELSE 48000 END AS sample_rate, CASE WHEN l_linenumber = 2 THEN 8 ELSE 24 END AS bit_depth, l_linenumber = 3 AS layout_guessed, CASE WHEN l_linenumber = 5 THEN 0.021 ELSE 0.0 END AS start_offset, CASE WHEN l_quantity > 48 THEN -120.0 ELSE -22 - round({Q}) / 16 END AS integrated, -80.0 AS sample_peak, -23.0 AS target, 0.5 AS tolerance, -1.0 AS max_true_peak, -3.0 + {Q} / 16 AS true_peak, CASE WHEN l_returnflag = 'A' THEN 1.5 ELSE 0.0 END AS lead_silence, CASE WHEN l_returnflag = 'R' THEN 2.5 ELSE 0.0 END AS trail_silence, l_linenumber % 2 AS silences",
    "channel": f"l_orderkey * 8 + l_linenumber AS video_id, CASE l_linenumber WHEN 1 THEN 'FL' WHEN 2 THEN 'FR' WHEN 3 THEN 'FC' WHEN 4 THEN 'LFE' WHEN 5 THEN 'C02' ELSE 'BL' END AS channel, l_returnflag = 'A' AS muted, l_linestatus = 'F' AS surround, l_linenumber % 2 AS silences, (CAST(l_discount AS DOUBLE) - 0.05) / 10 AS dc, CASE WHEN l_quantity > 40 THEN 3 ELSE 0 END AS clipped",
    "pair": f"l_orderkey * 8 + l_linenumber AS video_id, {Q} / 25 - 1 AS correlation, l_linenumber % 2 AS out_of_phase, l_quantity = 50 AS identical, -90.0 AS difference",
    "hdr": f"l_orderkey * 8 + l_linenumber AS video_id, CASE WHEN l_linenumber = 7 THEN 8 ELSE 0 END AS dolby_profile, l_linenumber = 6 AS hdr10_plus, l_linenumber < 6 AS hdr, CASE WHEN l_returnflag = 'A' THEN 'bt709' ELSE 'bt2020' END AS primaries, CASE WHEN l_returnflag = 'R' THEN 'bt709' ELSE 'bt2020nc' END AS matrix, l_linenumber + 6 AS bits, CASE WHEN l_linenumber = 2 THEN 'pc' ELSE 'tv' END AS colour_range, CASE WHEN l_linenumber = 1 THEN 'arib-std-b67' ELSE 'smpte2084' END AS transfer, l_linestatus = 'F' AS mastering, CASE WHEN l_quantity < 5 THEN 0 ELSE 30 * {Q} END AS max_cll, CASE WHEN l_quantity < 7 THEN 0 ELSE 5 * {Q} END AS max_fall, 30 * {Q} * (0.7 + 8 * CAST(l_discount AS DOUBLE)) AS robust_cll, 32 * {Q} * (0.7 + 8 * CAST(l_discount AS DOUBLE)) AS measured_cll, 5 * {Q} * (0.8 + 6 * CAST(l_tax AS DOUBLE)) AS measured_fall",
    "comparison": f"l_orderkey * 8 + l_linenumber AS video_id, CASE WHEN l_linenumber = 1 THEN 'cpu' ELSE '' END AS fallback, CASE WHEN l_linenumber = 2 THEN '5%' ELSE '' END AS clamped, {Q} + 40 AS worst, 80.0 AS mean, CAST(l_discount AS DOUBLE) AS drops, 70.0 AS drop_threshold, l_linenumber % 3 AS banded_segments, l_linestatus = 'F' AS sampled",
    "ladder": f"l_orderkey * 8 + l_linenumber AS video_id, l_linenumber % 4 AS rungs, {Q} + 48 AS top_quality, 95.0 AS target, CASE WHEN l_returnflag = 'A' THEN 'h264' ELSE 'av1' END AS codec, round(CAST(l_extendedprice AS DOUBLE)) * 150 AS top_rate, l_linestatus = 'F' AS verified, CAST(l_discount AS DOUBLE) * 50 AS worst_gap, 6.0 AS step",
    "rung": f"l_orderkey * 8 + l_linenumber AS video_id, l_linenumber = 7 AS extrapolated, {Q} / 50 - 0.5 AS per_shot_gain, CAST(l_tax AS DOUBLE) AS banded, CAST(l_discount AS DOUBLE) * 10 AS inherited",
    "title": f"l_orderkey * 8 + l_linenumber AS video_id, {Q} / 5 + 85 AS quality, 90.0 AS program",
}
RULES = {"video": findings.VIDEO, "audio": findings.AUDIO, "channel": findings.CHANNEL, "pair": findings.PAIR, "hdr": findings.HDR, "comparison": findings.COMPARISON, "ladder": findings.LADDER, "rung": findings.RUNG, "title": findings.TITLE}


def _findings_query(kind: str) -> None:
    @query(f"findings_{kind}", f"WITH re AS (SELECT {REPORTS[kind]} FROM lineitem) {findings.found_sql('re', RULES[kind])}")
    def run(spark, sf):
        return findings.found(t.table(spark, sf, "lineitem").selectExpr(*_columns(REPORTS[kind])), RULES[kind])


def _columns(text: str) -> list[str]:
    """The expressions of a select list."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[begin:i])
            begin = i + 1
    return [*out, text[begin:]]


for _kind in REPORTS:
    _findings_query(_kind)


@query("findings_program_even", "SELECT l_orderkey AS program_id, 'ok' AS level, 'program-even' AS code, round(max(abs(CAST(l_quantity AS DOUBLE) / 5 - 5)), 6) AS value, CAST(2 AS DOUBLE) AS \"limit\" FROM lineitem GROUP BY 1 HAVING count(*) > 1 AND max(abs(CAST(l_quantity AS DOUBLE) / 5 - 5)) <= 2")
def found_even(spark, sf):
    q = F.col("l_quantity").cast("double") / 5
    return findings.program_even(t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("program_id"), q.alias("quality"), F.lit(5.0).alias("program")))


@query("findings_codecs", "WITH r AS (SELECT o_custkey AS video_id, o_orderstatus AS codec, avg(o_totalprice) AS rate FROM orders GROUP BY ALL), b AS (SELECT video_id, rate AS base FROM r WHERE codec = 'F'), g AS (SELECT video_id, codec, round(rate / base - 1, 6) AS gap FROM r JOIN b USING (video_id) WHERE codec <> 'F') SELECT video_id, codec, CASE WHEN gap < -0.03 THEN 'saving' WHEN gap > 0.03 THEN 'costlier' ELSE 'even' END AS code, gap FROM g")
def found_codecs(spark, sf):
    r = t.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("video_id"), F.col("o_orderstatus").alias("codec")).agg(F.avg("o_totalprice").alias("rate"))
    return findings.codec_rules(r, "F")
