"""Every registered query of the media operators and the SQL that says the same.

Doubles are rounded in both, as sums depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..functions import stats
from ..operators import audio, findings, ladder, seq
from ..sources import ingest
from . import tables as t

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

P = "p AS (SELECT user_id AS video_id, event_id AS pos, epoch_us(ts) * 1000 AS pts, CAST(40000000 AS BIGINT) AS dur, CAST(round(value * 100) AS BIGINT) AS size, event_type = 'signup' AS key, event_type, value FROM events)"
E = P + ", e AS (SELECT p.*, max(pts) OVER (PARTITION BY video_id) + 40000000 AS \"end\" FROM p)"
S = P + ", s AS (SELECT *, value / 1e5 AS energy, value - 50 AS l, CASE WHEN event_type = 'error' THEN 50 - value ELSE value - 40 END AS r FROM p)"
C = "c AS (SELECT l_suppkey % 20 AS video_id, l_returnflag || l_linestatus AS stratum, l_extendedprice / 1000 AS mean, CAST(l_quantity AS INT) AS frames, l_orderkey % 3 = 0 AS scored FROM lineitem), st AS (SELECT video_id, stratum, sum(frames) AS size, count(*) AS slots FROM c GROUP BY ALL)"
B = "pr AS (SELECT l_partkey AS title, CASE l_linenumber % 3 WHEN 0 THEN 360 WHEN 1 THEN 720 ELSE 1080 END AS height, CAST(round(l_extendedprice) AS BIGINT) AS bitrate, l_quantity FROM lineitem), pb AS (SELECT title, height, bitrate, max(round(100.0 * (1 - exp(-bitrate / (height * 40.0))) - l_quantity / 20, 4)) AS vmaf FROM pr GROUP BY ALL)"
ISO = B + """, o AS (SELECT *, row_number() OVER (PARTITION BY title, height ORDER BY bitrate, vmaf) AS i FROM pb),
jk AS (SELECT a.title, a.height, a.i AS j, b.i AS k, avg(m.vmaf) AS m FROM o a JOIN o b ON a.title = b.title AND a.height = b.height AND a.i <= b.i JOIN o m ON m.title = a.title AND m.height = a.height AND m.i BETWEEN a.i AND b.i GROUP BY ALL),
cu AS (SELECT o.title, o.height, o.bitrate, o.vmaf, (SELECT max(lo) FROM (SELECT j, min(m) AS lo FROM jk WHERE jk.title = o.title AND jk.height = o.height AND j <= o.i AND k >= o.i GROUP BY j)) AS fitted FROM o)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def r6(c: str | Column, name: str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits).alias(name)


# ---- bitstream ------------------------------------------------------------------------------------------------
@query("w1_bitrate_series", f"""WITH {P}, g AS (SELECT video_id, min(pts) AS s, max(pts) + 40000000 AS e, CAST(greatest(1, ceil((max(pts) + 40000000 - min(pts)) / 86400000000000.0)) AS BIGINT) AS n FROM p GROUP BY 1),
b AS (SELECT p.video_id, least((pts - s) // 86400000000000, n - 1) AS bucket, sum(size) AS bytes FROM p JOIN g USING (video_id) GROUP BY ALL),
d AS (SELECT video_id, s, e, n, unnest(range(0, n)) AS bucket FROM g)
SELECT video_id, bucket, bucket * 86400000000000 AS start, CAST(round(coalesce(bytes, 0) * 8 / (CASE WHEN bucket = n - 1 THEN e - s - bucket * 86400000000000 ELSE 86400000000000 END / 1e9)) AS BIGINT) AS bitrate FROM d LEFT JOIN b USING (video_id, bucket)""")
def w1(spark, sf):
    return seq.bitrate_series(t.packets(spark, sf), t.DAY)


@query("w2_peak_bitrate", f"""WITH {P}, w AS (SELECT *, sum(size) OVER (PARTITION BY video_id ORDER BY pts RANGE BETWEEN CURRENT ROW AND 86399999999999 FOLLOWING) AS bytes FROM p)
SELECT video_id, pts, CAST(round(bytes * 8 / 86400.0) AS BIGINT) AS bitrate FROM w QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY bytes DESC, pts, pos) = 1""")
def w2(spark, sf):
    return seq.peak_bitrate(t.packets(spark, sf), t.DAY)


@query("w3_trailing_bitrate", f"WITH {P} SELECT video_id, pos, pts, CAST(round(sum(size) OVER (PARTITION BY video_id ORDER BY pts RANGE BETWEEN 86399999999999 PRECEDING AND CURRENT ROW) * 8 / 86400.0) AS BIGINT) AS bitrate FROM p")
def w3(spark, sf):
    return seq.trailing_bitrate(t.packets(spark, sf), t.DAY)


@query("w5_min_per_bin", f"WITH {P} SELECT video_id, pts // 86400000000000 AS bin, min(value) AS worst FROM p GROUP BY ALL")
def w5(spark, sf):
    return t.packets(spark, sf).groupBy("video_id", F.expr(f"pts div {t.DAY}").alias("bin")).agg(F.min("value").alias("worst"))


@query("a6_packet_sizes", f"WITH {P} SELECT video_id, min(size) AS min, max(size) AS max, round(avg(size), 6) AS mean, quantile_disc(size, 0.5) AS p50, quantile_disc(size, 0.95) AS p95 FROM p GROUP BY 1")
def a6(spark, sf):
    return t.packets(spark, sf).groupBy("video_id").agg(F.min("size").alias("min"), F.max("size").alias("max"), r6(F.avg("size"), "mean"), stats.nearest_rank("size", 0.5).cast("long").alias("p50"), stats.nearest_rank("size", 0.95).cast("long").alias("p95"))


@query("a7_average_bitrate", f"WITH {P} SELECT video_id, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes, max(pts) + 40000000 - min(pts) AS duration, CAST(round(sum(size) * 8 / ((max(pts) + 40000000 - min(pts)) / 1e9)) AS BIGINT) AS bitrate FROM p GROUP BY 1")
def a7(spark, sf):
    length = F.max("pts") + F.max_by("dur", F.struct("pts", "pos")) - F.min("pts")
    return t.packets(spark, sf).groupBy("video_id").agg(F.count("*").alias("packets"), F.sum("size").alias("bytes"), length.alias("duration"), F.round(F.sum("size") * 8 / (length / fn.NS)).cast("long").alias("bitrate"))


def gops(p: DataFrame) -> DataFrame:
    """Least, greatest and mean interval of key packets; fixed if both extremes lie within one and a half mean packet durations of the mean."""
    k = p.where("key").select("video_id", "pts", (F.col("pts") - F.lag("pts").over(seq.in_order("pos"))).alias("d"))
    g = k.groupBy("video_id").agg(F.count("*").alias("keys"), F.coalesce(F.min("d"), F.lit(0)).alias("shortest"), F.coalesce(F.max("d"), F.lit(0)).alias("longest"), F.expr("coalesce((max(pts) - min(pts)) div nullif(count(*) - 1, 0), 0)").alias("mean"))
    frame = p.groupBy("video_id").agg(F.expr("coalesce((max(pts) - min(pts)) div nullif(count(*) - 1, 0), 0)").alias("frame"))
    near = lambda c: F.abs(F.col(c) - F.col("mean")) * 2 <= 3 * F.col("frame")
    return g.join(frame, "video_id").select("video_id", "keys", "shortest", "longest", "mean", (near("shortest") & near("longest")).alias("fixed"))


@query("a8_gop_stats", f"""WITH {P}, k AS (SELECT video_id, pts, pts - lag(pts) OVER (PARTITION BY video_id ORDER BY pts, pos) AS d FROM p WHERE key),
g AS (SELECT video_id, count(*) AS keys, coalesce(min(d), 0) AS shortest, coalesce(max(d), 0) AS longest, coalesce((max(pts) - min(pts)) // nullif(count(*) - 1, 0), 0) AS mean FROM k GROUP BY 1),
f AS (SELECT video_id, coalesce((max(pts) - min(pts)) // nullif(count(*) - 1, 0), 0) AS frame FROM p GROUP BY 1)
SELECT video_id, keys, shortest, longest, mean, abs(shortest - mean) * 2 <= 3 * frame AND abs(longest - mean) * 2 <= 3 * frame AS fixed FROM g JOIN f USING (video_id)""")
def a8(spark, sf):
    return gops(t.packets(spark, sf))


# ---- runs and sessions ----------------------------------------------------------------------------------------
RUN = """, x AS (SELECT *, coalesce(lead(pts) OVER w, "end") AS nx, value < 30 AS f, row_number() OVER w - row_number() OVER (PARTITION BY video_id, value < 30 ORDER BY pts, pos) AS g FROM e WINDOW w AS (PARTITION BY video_id ORDER BY pts, pos))"""


@query("w6_flag_runs", f"""WITH {E}{RUN} SELECT video_id, min(pts) AS start, max(nx) AS "end", count(*) AS n FROM x WHERE f GROUP BY video_id, g HAVING max(nx) - min(pts) >= 3600000000000""")
def w6(spark, sf):
    return seq.flag_runs(t.with_end(t.packets(spark, sf)), F.col("value") < 30, t.HOUR)


@query("w7_banding_sessions", f"""WITH {P}, x AS (SELECT *, value > 25 AS m, lag(value > 25) OVER w AS lm, pts - lag(pts) OVER w AS d FROM p WINDOW w AS (PARTITION BY video_id ORDER BY pts, pos)),
y AS (SELECT *, sum(CASE WHEN lm AND d <= 43200000000000 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY pts, pos) AS session FROM x WHERE m)
SELECT video_id, CAST(session AS BIGINT) AS session, min(pts) AS start, max(pts) AS "end", count(*) AS n, max(value) AS worst FROM y GROUP BY video_id, session""")
def w7(spark, sf):
    return seq.sessions(t.packets(spark, sf), F.col("value") > 25, 12 * t.HOUR)


@query("w8_freeze_flags", f"WITH {P}, x AS (SELECT *, coalesce(event_type = lag(event_type) OVER w, false) AS rep FROM p WINDOW w AS (PARTITION BY video_id ORDER BY pts, pos)) SELECT video_id, pos, rep OR coalesce(lead(rep) OVER (PARTITION BY video_id ORDER BY pts, pos), false) AS frozen FROM x")
def w8(spark, sf):
    w = seq.in_order("pos")
    r = t.packets(spark, sf).withColumn("rep", F.coalesce(F.col("event_type") == F.lag("event_type").over(w), F.lit(False)))
    return r.select("video_id", "pos", (F.col("rep") | F.coalesce(F.lead("rep").over(w), F.lit(False))).alias("frozen"))


@query("w15_shots", f"""WITH {E}, k AS (SELECT DISTINCT video_id, pts AS start, "end" AS e FROM e WHERE key UNION SELECT video_id, min(pts), max("end") FROM e GROUP BY 1)
SELECT video_id, CAST(row_number() OVER w - 1 AS INT) AS shot, start, coalesce(lead(start) OVER w, e) AS "end" FROM k WINDOW w AS (PARTITION BY video_id ORDER BY start)""")
def w15(spark, sf):
    return shots(t.with_end(t.packets(spark, sf)))


def shots(p: DataFrame) -> DataFrame:
    return seq.shots(p.where("key").select("video_id", "pts"), p.groupBy("video_id").agg(F.min("pts").alias("start"), F.max("end").alias("end")))


@query("w28_frame_durations", f"WITH {P} SELECT video_id, pos, coalesce(lead(pts) OVER w - pts, pts - lag(pts) OVER w, 0) AS duration FROM p WINDOW w AS (PARTITION BY video_id ORDER BY pts, pos)")
def w28(spark, sf):
    w = seq.in_order("pos")
    return t.packets(spark, sf).select("video_id", "pos", F.coalesce(F.lead("pts").over(w) - F.col("pts"), F.col("pts") - F.lag("pts").over(w), F.lit(0)).alias("duration"))


@query("w29_coalesced_events", f"""WITH {E}, x AS (SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY video_id, event_type ORDER BY pts, pos) AS g, coalesce(lead(pts) OVER w, "end") AS nx FROM e WINDOW w AS (PARTITION BY video_id ORDER BY pts, pos))
SELECT video_id, event_type AS text, min(pts) AS start, max(nx) AS "end" FROM x GROUP BY video_id, event_type, g""")
def w29(spark, sf):
    w = seq.in_order("pos")
    r = seq.islands(t.with_end(t.packets(spark, sf)).withColumn("nx", F.coalesce(F.lead("pts").over(w), F.col("end"))), F.col("event_type"))
    return r.groupBy("video_id", "island").agg(F.first("event_type").alias("text"), F.min("pts").alias("start"), F.max("nx").alias("end")).drop("island")


# ---- smoothing ------------------------------------------------------------------------------------------------
@query("w11_interpolated", f"""WITH {P}, x AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS v, row_number() OVER w AS i FROM p WINDOW w AS (PARTITION BY video_id ORDER BY pts, pos)),
y AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, last_value(v IGNORE NULLS) OVER b AS pv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni, first_value(v IGNORE NULLS) OVER a AS nv FROM x WINDOW b AS (PARTITION BY video_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY video_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT video_id, pos, round(coalesce(v, pv + (nv - pv) * (i - pi) / (ni - pi), pv, nv), 6) AS filled FROM y""")
def w11(spark, sf):
    return seq.interpolated(t.packets(spark, sf), F.when(F.col("event_type") != "error", F.col("value"))).select("video_id", "pos", r6("filled", "filled"))


@query("w12_moving_average", f"WITH {P} SELECT video_id, pos, round(avg(value) OVER (PARTITION BY video_id ORDER BY pts, pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth FROM p")
def w12(spark, sf):
    return seq.moving_average(t.packets(spark, sf), "value", 3).select("video_id", "pos", r6("smooth", "smooth"))


TREND = ", q AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pts, pos) AS i FROM p), z AS (SELECT *, regr_slope(value, i) OVER b AS sl, avg(value) OVER b AS av, avg(i) OVER b AS ai FROM q WINDOW b AS (PARTITION BY video_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))"


@query("w13_local_trend", f"WITH {P}{TREND} SELECT video_id, pos, round(av + coalesce(CASE WHEN isnan(sl) THEN 0 ELSE sl END, 0) * (i - ai), 4) AS trend FROM z")
def w13(spark, sf):
    return seq.local_trend(t.packets(spark, sf), "value", 3).select("video_id", "pos", r6("trend", "trend", 4))


# ---- scenes ---------------------------------------------------------------------------------------------------
def scene_scores(spark, sf) -> DataFrame:
    e = t.table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("video_id"), F.col("vec_id").alias("pos"), (F.col("vec_id") * t.FRAME).alias("pts"), "embedding")
    before = F.lag("embedding").over(seq.in_order("pos"))
    return e.withColumn("score", F.coalesce(fn.mean_abs_difference(F.col("embedding"), before) * 100, F.lit(0.0))).drop("embedding")


@query("w9_scene_score", """WITH x AS (SELECT CAST(label AS BIGINT) AS video_id, vec_id AS pos, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT video_id, pos, round(coalesce(list_avg(list_transform(list_zip(e, b), lambda p: abs(CAST(p[1] AS DOUBLE) - p[2]))) * 100, 0), 4) AS score FROM x""")
def w9(spark, sf):
    return scene_scores(spark, sf).select("video_id", "pos", r6("score", "score", 4))


@query("w10_scene_cuts")
def w10(spark, sf):
    return seq.scene_cuts(scene_scores(spark, sf), threshold=12.0, ratio=1.1, min_gap=5 * t.FRAME)


# ---- joins ----------------------------------------------------------------------------------------------------
@query("j3_asof_forward", f"""WITH {P}, l AS (SELECT DISTINCT video_id, pts + 3600000000000 AS t FROM p WHERE key), r AS (SELECT video_id, pts, pos FROM p WHERE event_type = 'view')
SELECT l.video_id, t, min_by(pos, (pts, pos)) AS match FROM l JOIN r ON l.video_id = r.video_id AND r.pts >= t GROUP BY ALL""")
def j3(spark, sf):
    p = t.packets(spark, sf)
    return seq.asof_forward(p.where("key").select("video_id", (F.col("pts") + t.HOUR).alias("t")).distinct(), p.where("event_type = 'view'"), "pos")


@query("j4_asof_nearest", f"""WITH {P}, l AS (SELECT DISTINCT video_id, pts AS t FROM p WHERE event_type = 'error'), r AS (SELECT video_id, pts, pos FROM p WHERE event_type = 'view'),
j AS (SELECT l.video_id, t, pos AS match, abs(pts - t) AS distance, row_number() OVER (PARTITION BY l.video_id, t ORDER BY abs(pts - t), pts DESC) AS n FROM l JOIN r ON l.video_id = r.video_id AND abs(pts - t) <= 43200000000000)
SELECT video_id, t, match, distance FROM j WHERE n = 1""")
def j4(spark, sf):
    p = t.packets(spark, sf)
    return seq.asof_nearest(p.where("event_type = 'error'").select("video_id", F.col("pts").alias("t")).distinct(), p.where("event_type = 'view'"), "pos", 12 * t.HOUR)


SHOTS = """, k AS (SELECT DISTINCT video_id, pts AS start, "end" AS e FROM e WHERE key UNION SELECT video_id, min(pts), max("end") FROM e GROUP BY 1), sh AS (SELECT video_id, CAST(row_number() OVER w - 1 AS BIGINT) AS id, start, coalesce(lead(start) OVER w, e) AS fin FROM k WINDOW w AS (PARTITION BY video_id ORDER BY start))"""


@query("j5_frame_in_shot_means", f"""WITH {E}{SHOTS} SELECT e.video_id, id AS shot, count(*) AS frames, round(avg(value), 6) AS si, round(avg(CASE WHEN pts > start OR n = 1 THEN value END), 6) AS ti
FROM (SELECT e.*, sh.id, sh.start, count(*) OVER (PARTITION BY e.video_id, sh.id) AS n FROM e JOIN sh ON e.video_id = sh.video_id AND pts >= start AND pts < fin) e GROUP BY ALL""")
def j5(spark, sf):
    p = t.with_end(t.packets(spark, sf))
    first = shots(p).select("video_id", F.col("shot").cast("long").alias("shot"), "start")
    w = seq.in_order("side", "pos").rowsBetween(Window.unboundedPreceding, 0)
    u = p.select("video_id", "pts", F.lit(1).alias("side"), "pos", "value", F.lit(None).cast("struct<shot:bigint,start:bigint>").alias("s")).unionByName(
        first.select("video_id", F.col("start").alias("pts"), F.lit(0).alias("side"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("double").alias("value"), F.struct("shot", "start").alias("s"))
    )
    j = u.withColumn("s", F.last("s", ignorenulls=True).over(w)).where("side = 1").withColumn("n", F.count("*").over(Window.partitionBy("video_id", "s.shot")))
    later = F.when((F.col("pts") > F.col("s.start")) | (F.col("n") == 1), F.col("value"))
    return j.withColumn("ti", later).groupBy("video_id", F.col("s.shot").alias("shot")).agg(F.count("*").alias("frames"), r6(F.avg("value"), "si"), r6(F.avg("ti"), "ti"))


@query("j7_overlap_weights", f"""WITH {E}{SHOTS}, d AS (SELECT DISTINCT video_id, pts // 172800000000000 AS id FROM p)
SELECT sh.video_id, sh.id AS a_id, d.id AS b_id, least(fin, (d.id + 1) * 172800000000000) - greatest(start, d.id * 172800000000000) AS overlap FROM sh JOIN d ON sh.video_id = d.video_id AND start < (d.id + 1) * 172800000000000 AND fin > d.id * 172800000000000""")
def j7(spark, sf):
    p = t.with_end(t.packets(spark, sf))
    two = 2 * t.DAY
    b = p.select("video_id", F.expr(f"pts div {two}").alias("id")).distinct().select("video_id", "id", (F.col("id") * two).alias("start"), ((F.col("id") + 1) * two).alias("end"))
    return seq.overlap_join(shots(p).withColumn("id", F.col("shot").cast("long")), b, two)


@query("j9_rank_conflicts", """WITH x AS (SELECT o_custkey AS video_id, o_orderkey AS rung, o_totalprice / 5000 AS vmaf, o_orderkey % 13 / 2.0 AS xpsnr FROM orders)
SELECT a.video_id, a.rung AS better, b.rung AS worse FROM x a JOIN x b ON a.video_id = b.video_id AND a.rung <> b.rung AND a.vmaf - b.vmaf >= 2.0 AND b.xpsnr - a.xpsnr >= 0.5""")
def j9(spark, sf):
    o = t.table(spark, sf, "orders")
    return findings.rank_conflicts(o.select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("rung"), (F.col("o_totalprice") / 5000).alias("vmaf"), (F.col("o_orderkey") % 13 / 2.0).alias("xpsnr")))


@query("j13_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j13(spark, sf):
    return t.table(spark, sf, "customer").join(t.table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("j15_complete_titles", "WITH g AS (SELECT DISTINCT l_shipdate IS NOT NULL AS x, l_returnflag, l_linestatus FROM lineitem) SELECT l_suppkey AS title, count(DISTINCT l_returnflag || l_linestatus) AS points FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag || l_linestatus) = (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM g)")
def j15(spark, sf):
    li = t.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("title"), F.concat("l_returnflag", "l_linestatus").alias("point")).distinct()
    want = li.agg(F.count_distinct("point").alias("want"))
    return li.groupBy("title").agg(F.count("*").alias("points")).join(F.broadcast(want), F.col("points") == F.col("want")).select("title", "points")


# ---- audio ----------------------------------------------------------------------------------------------------
WIN = """, w AS (SELECT video_id, pos, pts, row_number() OVER o - 1 AS step, sum(energy) OVER (PARTITION BY video_id ORDER BY pts, pos ROWS BETWEEN {n} PRECEDING AND CURRENT ROW) / {m} AS energy FROM s WINDOW o AS (PARTITION BY video_id ORDER BY pts, pos))"""
LUFS = "round(CASE WHEN {x} > 0 THEN greatest(-120, -0.691 + 10 * log10({x})) ELSE -120 END, 2)"


@query("w16_momentary_loudness", f"WITH {S}{WIN.format(n=3, m=4)} SELECT video_id, pos, CAST(step AS BIGINT) AS step, {LUFS.format(x='energy')} AS level FROM w")
def w16(spark, sf):
    return audio.windowed(t.steps(spark, sf), 4).select("video_id", "pos", F.col("step").cast("long").alias("step"), "level")


@query("a13_gated_loudness", f"""WITH {S}{WIN.format(n=3, m=4)}, b AS (SELECT *, -0.691 + 10 * log10(energy) AS l FROM w WHERE step >= 3 AND energy > 0 AND -0.691 + 10 * log10(energy) >= -70),
g AS (SELECT video_id, -0.691 + 10 * log10(avg(energy)) - 10 AS gate FROM b GROUP BY 1) SELECT video_id, {LUFS.format(x='avg(energy)')} AS integrated, count(*) AS blocks FROM b JOIN g USING (video_id) WHERE l >= gate GROUP BY 1""")
def a13(spark, sf):
    return audio.gated(t.steps(spark, sf))


@query("a14_loudness_range", f"""WITH {S}{WIN.format(n=29, m=30)}, b AS (SELECT *, -0.691 + 10 * log10(energy) AS l FROM w WHERE step >= 29 AND energy > 0 AND -0.691 + 10 * log10(energy) >= -70),
g AS (SELECT video_id, -0.691 + 10 * log10(avg(energy)) - 20 AS gate FROM b GROUP BY 1), h AS (SELECT video_id, list_sort(list(l)) AS v FROM b JOIN g USING (video_id) WHERE l >= gate GROUP BY 1)
SELECT video_id, round(v[CAST(floor((len(v) - 1) * 0.95 + 0.5) AS INT) + 1] - v[CAST(floor((len(v) - 1) * 0.10 + 0.5) AS INT) + 1], 2) AS range FROM h""")
def a14(spark, sf):
    return audio.loudness_range(t.steps(spark, sf))


@query("a15_max_level", f"WITH {S}{WIN.format(n=3, m=4)} SELECT video_id, max({LUFS.format(x='energy')}) AS max_level FROM w WHERE step >= 3 GROUP BY 1")
def a15(spark, sf):
    return audio.max_level(t.steps(spark, sf), 4)


@query("a17_pair_correlation", f"WITH {S} SELECT video_id, round(sum(l * r) / sqrt(sum(l * l) * sum(r * r)), 6) AS correlation, bool_and(l = r) AS identical, bool_and(l = -r) AS inverted, round(avg(abs(l - r)), 6) AS difference FROM s GROUP BY 1")
def a17(spark, sf):
    return audio.pair_correlation(t.steps(spark, sf), "left", "right").select("video_id", r6("correlation", "correlation"), "identical", "inverted", r6("difference", "difference"))


@query("w17_phase", f"""WITH {S}, x AS (SELECT video_id, pos, sum(l * r) OVER b AS lr, sum(l * l) OVER b AS ll, sum(r * r) OVER b AS rr FROM s WINDOW b AS (PARTITION BY video_id ORDER BY pts, pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT video_id, pos, round(CASE WHEN ll > 1e-9 AND rr > 1e-9 THEN lr / sqrt(ll * rr) ELSE 0 END, 5) AS phase FROM x""")
def w17(spark, sf):
    return audio.phase(t.steps(spark, sf), "left", "right").select("video_id", "pos", r6("phase", "phase", 5))


@query("w19_merged_runs", f"""WITH {E}{RUN}, ru AS (SELECT video_id, min(pts) AS a, max(nx) AS b, count(*) AS n FROM x WHERE f GROUP BY video_id, g),
m AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY video_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 14400000000000 THEN 0 ELSE 1 END AS s FROM ru),
z AS (SELECT *, sum(s) OVER (PARTITION BY video_id ORDER BY a) AS run FROM m) SELECT video_id, CAST(run AS BIGINT) AS run, min(a) AS start, max(b) AS "end", CAST(sum(n) AS BIGINT) AS n FROM z WHERE run <= 100 GROUP BY video_id, run""")
def w19(spark, sf):
    return audio.merged_runs(seq.flag_runs(t.with_end(t.packets(spark, sf)), F.col("value") < 30), 4 * t.HOUR)


# ---- statistics and sampling ----------------------------------------------------------------------------------
@query("a1_summary", "SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS mean, min(l_extendedprice) AS min, max(l_extendedprice) AS max, quantile_disc(l_extendedprice, 0.05) AS p5, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY ALL")
def a1(spark, sf):
    s = stats.summarize(t.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return s.withColumn("mean", F.round("mean", 4))


@query("a4_upper_median", f"WITH {P}, x AS (SELECT video_id, list_sort(list(value)) AS v FROM p GROUP BY 1) SELECT video_id, v[len(v) // 2 + 1] AS median FROM x")
def a4(spark, sf):
    return stats.upper_median(t.packets(spark, sf), ["video_id"], "value")


@query("a5_population_sigma", f"WITH {P} SELECT video_id, round(stddev_pop(value), 6) AS sigma FROM p GROUP BY 1")
def a5(spark, sf):
    v = F.col("value")
    return t.packets(spark, sf).groupBy("video_id").agg(r6(stats.population_sigma(F.sum(v), F.sum(v * v), F.count("*")), "sigma"))


EST = C + ", a AS (SELECT video_id, stratum, sum(mean * frames) / sum(frames) AS m, count(*) AS n, var_samp(mean) AS v FROM c WHERE scored GROUP BY ALL), x AS (SELECT a.*, size, slots, size / sum(size) OVER (PARTITION BY a.video_id) AS w FROM a JOIN st USING (video_id, stratum))"


@query("a18_stratified_mean", f"WITH {EST} SELECT video_id, round(sum(w * m), 6) AS mean FROM x GROUP BY 1")
def a18(spark, sf):
    c = t.clips(spark, sf)
    return stats.pooled_estimate(c.where("scored"), t.strata(c)).select("video_id", r6("mean", "mean"))


@query("a19_pooled_variance", f"WITH {EST} SELECT video_id, round(coalesce(sum(CASE WHEN n > 1 THEN v * (n - 1) END) / nullif(sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END), 0), 0), 4) AS variance, CAST(sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END) AS BIGINT) AS df FROM x GROUP BY 1")
def a19(spark, sf):
    c = t.clips(spark, sf)
    return stats.pooled_estimate(c.where("scored"), t.strata(c)).select("video_id", r6("variance", "variance", 4), "df")


@query("a20_pooled_estimate")
def a20(spark, sf):
    c = t.clips(spark, sf)
    return stats.pooled_estimate(c.where("scored"), t.strata(c))


@query("a21_separate_estimate")
def a21(spark, sf):
    c = t.clips(spark, sf)
    return stats.separate_estimate(c.where("scored"), t.strata(c))


@query("a24_harmonic_mean", f"WITH {P} SELECT video_id, round(1 / avg(1 / (value + 1)) - 1, 6) AS harmonic, round(avg(CASE WHEN value < 40 THEN 1.0 ELSE 0.0 END), 6) AS drops FROM p GROUP BY 1")
def a24(spark, sf):
    v = F.col("value")
    return t.packets(spark, sf).groupBy("video_id").agg(r6(1 / F.avg(1 / (v + 1)) - 1, "harmonic"), r6(F.avg((v < 40).cast("double")), "drops"))


@query("t8_pilot_draw", "WITH c AS (SELECT l_suppkey % 20 AS video_id, l_returnflag || l_linestatus AS stratum, l_orderkey, l_linenumber, (CAST(l_orderkey AS BIGINT) * 8 + l_linenumber) * 2654435761 % 4294967296 AS h FROM lineitem) SELECT video_id, stratum, l_orderkey, l_linenumber FROM c QUALIFY row_number() OVER (PARTITION BY video_id, stratum ORDER BY h, l_orderkey, l_linenumber) <= 2")
def t8(spark, sf):
    c = t.clips(spark, sf).withColumn("h", (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 2654435761 % 4294967296)
    w = Window.partitionBy("video_id", "stratum").orderBy("h", "l_orderkey", "l_linenumber")
    return c.withColumn("n", F.row_number().over(w)).where("n <= 2").select("video_id", "stratum", "l_orderkey", "l_linenumber")


@query("t9_allocation", f"WITH {C}, x AS (SELECT video_id, stratum, size / sum(size) OVER (PARTITION BY video_id) AS w FROM st), g AS (SELECT video_id, stratum, n, round(w * w * (1.0 / n - 1.0 / (n + 1)), 12) AS gain FROM x, range(2, 22) r(n)), k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY gain DESC, stratum, n) <= 12) SELECT video_id, stratum, count(*) AS more FROM k GROUP BY ALL")
def t9(spark, sf):
    s = t.strata(t.clips(spark, sf)).withColumn("w", F.col("frames") / F.sum("frames").over(Window.partitionBy("video_id")))
    g = s.select("video_id", "stratum", "w", F.explode(F.sequence(F.lit(2), F.lit(21))).alias("n"))
    g = g.withColumn("gain", F.round(F.col("w") * F.col("w") * (1 / F.col("n") - 1 / (F.col("n") + 1)), 12))
    w = Window.partitionBy("video_id").orderBy(F.desc("gain"), "stratum", "n")
    return g.withColumn("k", F.row_number().over(w)).where("k <= 12").groupBy("video_id", "stratum").agg(F.count("*").alias("more"))


@query("w23_slots", "SELECT o_custkey AS stratum, s AS slot, s * 4 AS first, CASE WHEN s = greatest(1, n // 4) - 1 THEN n ELSE (s + 1) * 4 END AS last FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), LATERAL (SELECT unnest(range(0, greatest(1, n // 4))) AS s)")
def w23(spark, sf):
    g = t.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("stratum")).agg(F.count("*").alias("n")).withColumn("k", F.expr("greatest(1, n div 4)"))
    s = g.select("stratum", "n", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("slot"))
    return s.select("stratum", "slot", (F.col("slot") * 4).alias("first"), F.when(F.col("slot") == F.col("k") - 1, F.col("n")).otherwise((F.col("slot") + 1) * 4).alias("last"))


# ---- ladders --------------------------------------------------------------------------------------------------
@query("m1_curves", f"WITH {ISO} SELECT title, height, bitrate, vmaf, round(fitted, 6) AS fitted FROM cu")
def m1(spark, sf):
    return ladder.curves(t.probes(spark, sf)).select("title", "height", "bitrate", "vmaf", r6("fitted", "fitted"))


ENV = ISO + """, en AS (SELECT title, min(ln(bitrate)) AS lo, max(ln(bitrate)) AS hi FROM cu GROUP BY 1), gr AS (SELECT title, i, exp(lo + (hi - lo) * i / 49) AS rate FROM en, range(0, 50) r(i)),
sg AS (SELECT title, height, bitrate AS b0, fitted AS q0, coalesce(lead(bitrate) OVER w, bitrate) AS b1, coalesce(lead(fitted) OVER w, fitted) AS q1 FROM cu WINDOW w AS (PARTITION BY title, height ORDER BY bitrate)),
qa AS (SELECT gr.title, i, rate, height, q0 + CASE WHEN b0 = b1 THEN 0 ELSE (ln(rate) - ln(b0)) / (ln(b1) - ln(b0)) END * (q1 - q0) AS quality FROM gr JOIN sg ON gr.title = sg.title AND rate >= b0 AND (rate < b1 OR b0 = b1 AND rate = b0))"""


@query("m3_envelope", f"WITH {ENV} SELECT title, CAST(i AS INT) AS i, round(rate, 3) AS rate, height, round(quality + 1e-9, 5) AS quality FROM qa WHERE i BETWEEN 1 AND 48 QUALIFY row_number() OVER (PARTITION BY title, i ORDER BY quality DESC, height DESC) = 1")
def m3(spark, sf):
    e = ladder.envelope(ladder.curves(t.probes(spark, sf)), 50)
    return e.where("i BETWEEN 1 AND 48").select("title", "i", r6("rate", "rate", 3), "height", r6(F.col("quality") + 1e-9, "quality", 5))  # the ends depend on the last digit of exp(ln(x))


@query("m2_quality_at", f"WITH {ISO}, sg AS (SELECT title, height, bitrate AS b0, fitted AS q0, lead(bitrate) OVER w AS b1, lead(fitted) OVER w AS q1 FROM cu WINDOW w AS (PARTITION BY title, height ORDER BY bitrate)) SELECT title, height, CAST(r.rate AS DOUBLE) AS rate, round(q0 + (ln(r.rate) - ln(b0)) / (ln(b1) - ln(b0)) * (q1 - q0) + 1e-9, 5) AS quality FROM sg, (VALUES (20000.5), (35000.5), (60000.5)) r(rate) WHERE r.rate >= b0 AND r.rate < b1")
def m2(spark, sf):
    c = ladder.curves(t.probes(spark, sf))
    rates = c.select("title").distinct().select("title", F.explode(F.array(*map(F.lit, (20000.5, 35000.5, 60000.5)))).alias("rate"))
    return ladder.quality_at(c, rates).select("title", "height", "rate", r6(F.col("quality") + 1e-9, "quality", 5))


@query("m4_rungs")
def m4(spark, sf):
    return ladder.ladders(t.probes(spark, sf), 50, min_rate=1000.0).drop("lowered")


@query("m7_energy")
def m7(spark, sf):
    return ladder.ladders(t.probes(spark, sf), 50, min_rate=1000.0).select("title", "rung", "rate", "height", "lowered")


def menu(spark, sf) -> DataFrame:
    p = t.probes(spark, sf)
    return p.select("title", F.col("height").alias("unit"), F.col("bitrate").alias("position"), (F.col("bitrate") / 1e4).alias("rate"), F.col("vmaf").alias("quality"))


@query("m19_allocation", f"WITH {B} SELECT title, height AS unit, bitrate AS position, bitrate / 1e4 AS rate, vmaf AS quality FROM pb QUALIFY row_number() OVER (PARTITION BY title, height ORDER BY round(vmaf - 2.0 * (bitrate / 1e4), 9) DESC, bitrate) = 1")
def m19(spark, sf):
    return ladder.allocate(menu(spark, sf), 2.0)


@query("m20_price")
def m20(spark, sf):
    return ladder.allocation_price(menu(spark, sf), 60.0)


def rows_of_model(spark, sf) -> DataFrame:
    li = t.table(spark, sf, "lineitem")
    return li.select((F.col("l_linenumber") % 3).cast("int").alias("height"), F.ln("l_extendedprice").alias("y"), F.col("l_quantity").alias("f1"), F.col("l_discount").alias("f2"), F.col("l_tax").alias("f3"), "l_orderkey", "l_linenumber")


@query("m23_train_models")
def m23(spark, sf):
    return ladder.train_models(rows_of_model(spark, sf), ["f1", "f2", "f3"], "y", ["height"])


@query("m27_predict")
def m27(spark, sf):
    r = rows_of_model(spark, sf)
    m = ladder.train_models(r, ["f1", "f2", "f3"], "y", ["height"])
    return ladder.predict(r, m, ["f1", "f2", "f3"], ["height"]).groupBy("height").agg(r6(F.avg(F.exp("predicted")), "rate", 3), F.count("*").alias("n"))


# ---- scalar functions, rules ----------------------------------------------------------------------------------
@query("f8_f17_f23_scalars", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 8 THEN 'low' WHEN l_quantity < 25 THEN 'medium' ELSE 'high' END AS bucket,
round(ln(least(greatest(l_quantity * 2, 0.5), 99.5) / (100 - least(greatest(l_quantity * 2, 0.5), 99.5))), 6) AS logit, least(greatest(round(l_quantity / 3) * 3, 18), 42) AS crf, round((14 * l_quantity + l_tax + l_discount) / 16, 6) AS psnr FROM lineitem""")
def f8(spark, sf):
    q = F.col("l_quantity")
    return t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fn.bucket(q, 8, 25).alias("bucket"), r6(fn.link(q * 2), "logit"), fn.crf_step(q, 3, 18, 42).alias("crf"), r6(fn.psnr_yuv(q, F.col("l_tax"), F.col("l_discount")), "psnr"))


@query("f13_transfer_functions")
def f13(spark, sf):
    v = F.col("l_discount") * 9
    return t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(fn.pq_to_nits(v), "nits", 4), r6(fn.nits_to_pq(fn.pq_to_nits(v)), "code"), r6(fn.hlg_to_linear(v), "hlg"))


@query("f28_timecode", f"WITH {P}, x AS (SELECT video_id, pos, ((pts - min(pts) OVER (PARTITION BY video_id)) + 5000000) // 10000000 AS cs FROM p) SELECT video_id, pos, format('{{:02d}}:{{:02d}}.{{:02d}}', cs // 6000 % 60, cs // 100 % 60, cs % 100) AS clock FROM x")
def f28(spark, sf):
    p = t.packets(spark, sf)
    rel = F.col("pts") - F.min("pts").over(Window.partitionBy("video_id"))
    return p.select("video_id", "pos", F.right(fn.timecode(rel % (100 * t.HOUR)), F.lit(8)).alias("clock"))


def bitstream_report(spark, sf) -> DataFrame:
    p = t.packets(spark, sf)
    avg = w_average(p)
    peak = seq.peak_bitrate(p, t.DAY).select("video_id", F.col("bitrate").alias("peak"))
    keys = gops(p).select("video_id", (F.col("longest") / fn.NS).alias("max_interval"), F.col("keys").alias("keyframes"))
    j = avg.join(peak, "video_id").join(keys, "video_id", "left")
    return j.select("video_id", (F.col("peak") / F.nullif(F.col("average"), F.lit(0))).alias("peak_to_average"), "max_interval", "keyframes")


def w_average(p: DataFrame) -> DataFrame:
    length = F.max("pts") + F.max_by("dur", F.struct("pts", "pos")) - F.min("pts")
    return p.groupBy("video_id").agg(F.round(F.sum("size") * 8 / (length / fn.NS)).cast("long").alias("average"))


FOUND = P + f""", av AS (SELECT video_id, CAST(round(sum(size) * 8 / ((max(pts) + 40000000 - min(pts)) / 1e9)) AS BIGINT) AS average FROM p GROUP BY 1),
wi AS (SELECT *, sum(size) OVER (PARTITION BY video_id ORDER BY pts RANGE BETWEEN CURRENT ROW AND 86399999999999 FOLLOWING) AS bytes FROM p), pk AS (SELECT video_id, CAST(round(max(bytes) * 8 / 86400.0) AS BIGINT) AS peak FROM wi GROUP BY 1),
kg AS (SELECT video_id, pts - lag(pts) OVER (PARTITION BY video_id ORDER BY pts, pos) AS d FROM p WHERE key), ki AS (SELECT video_id, coalesce(max(d), 0) / 1e9 AS max_interval, count(*) AS keyframes FROM kg GROUP BY 1),
re AS (SELECT video_id, peak / nullif(average, 0) AS peak_to_average, max_interval, keyframes FROM av JOIN pk USING (video_id) LEFT JOIN ki USING (video_id)),
fi AS ({findings.found_sql("re", findings.BITSTREAM)})"""


@query("findings_bitstream", f"WITH {FOUND} SELECT * FROM fi")
def found(spark, sf):
    return findings.ranked(findings.found(bitstream_report(spark, sf), findings.BITSTREAM))


@query("a38_verdict", f"WITH {FOUND} SELECT re.video_id, CASE WHEN bool_or(level = 'warn') THEN 'attention' ELSE 'pass' END AS verdict FROM re LEFT JOIN fi USING (video_id) GROUP BY 1")
def a38(spark, sf):
    r = bitstream_report(spark, sf)
    return findings.verdict(r, findings.found(r, findings.BITSTREAM))


@query("s4_packet_lines", f"WITH {P} SELECT video_id, pos, pts, pts AS dts, dur, size, key FROM p")
def s4(spark, sf):
    p = t.packets(spark, sf)
    sec = lambda c: F.concat((F.expr(f"{c} div 1000000000")).cast("string"), F.lit("."), F.lpad((F.col(c) % fn.NS).cast("string"), 9, "0"))
    line = F.concat(F.lit("pts_time="), F.when(F.col("pos") % 2 == 0, sec("pts")).otherwise("N/A"), F.lit("|dts_time="), sec("pts"), F.lit("|duration_time=0.040|size="), F.col("size").cast("string"), F.lit("|flags="), F.when(F.col("key"), "K__").otherwise("___"))
    return ingest.packets(p.select("video_id", "pos", line.alias("value")))


from . import further, kernels, planned, wider  # noqa: E402, F401  (register their queries)
