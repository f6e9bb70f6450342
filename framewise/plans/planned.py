"""Registered queries of ladder planning. See registry.py for the common tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import planning
from . import tables as t
from .further import ONE, PROBE, probes, rows
from .registry import B, query, r6

HEIGHTS = [1080, 720, 720, 540, 360]


@query("x2_candidate_heights", "WITH s AS (SELECT o_orderkey AS title, CAST(200 + o_orderkey % 1000 AS BIGINT) AS source FROM orders), f AS (SELECT title, source, height FROM s JOIN (VALUES (1080), (720), (540), (360)) v(height) ON height <= source) SELECT title, source, height FROM f UNION ALL SELECT title, source, CAST(source AS INT) FROM s WHERE source < 360")
def x2(spark, sf):
    s = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("title"), (F.lit(200) + F.col("o_orderkey") % 1000).cast("long").alias("source"))
    return planning.candidate_heights(s, HEIGHTS).drop("place")


@query("x8_digest_pieces", """WITH sh AS (SELECT DISTINCT l_orderkey AS title, l_linenumber AS shot, (l_linenumber - 1) * 50 AS start, 50 AS frames FROM lineitem),
sg AS (SELECT o_orderkey AS title, k AS segment, 20 + k * 90 + o_orderkey % 30 AS start, 40 + k * 10 AS frames FROM orders, range(0, 3) r(k)), o AS (SELECT *, coalesce(sum(frames) OVER (PARTITION BY title ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM sg)
SELECT o.title, segment, shot, CAST(held + greatest(o.start, sh.start) - o.start AS BIGINT) AS start, CAST(least(o.start + o.frames, sh.start + sh.frames) - greatest(o.start, sh.start) AS BIGINT) AS frames
FROM o JOIN sh ON o.title = sh.title AND greatest(o.start, sh.start) < least(o.start + o.frames, sh.start + sh.frames)""")
def x8(spark, sf):
    sh = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("title"), F.col("l_linenumber").alias("shot"), ((F.col("l_linenumber") - 1) * 50).cast("long").alias("start"), F.lit(50).cast("long").alias("frames")).distinct()
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("segment")
    sg = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("title"), k).select("title", "segment", (F.lit(20) + F.col("segment") * 90 + F.col("title") % 30).alias("start"), (F.lit(40) + F.col("segment") * 10).alias("frames"))
    return planning.digest_pieces(sh, sg, 200)


NAMES = "CASE l_linenumber WHEN 1 THEN 'x264_' WHEN 2 THEN 'src_' WHEN 3 THEN 'scale_' ELSE 'si_' END || l_returnflag || CAST(l_suppkey AS VARCHAR)"


@query("x24_feature_sets", f"WITH n AS (SELECT DISTINCT {NAMES} AS name FROM lineitem) SELECT CAST(k AS INT) AS \"set\", name FROM n, range(0, 4) r(k) WHERE NOT starts_with(name, 'scale_') AND (k < 2 OR NOT starts_with(name, 'x264_')) AND (k % 2 = 0 OR NOT starts_with(name, 'src_'))")
def x24(spark, sf):
    return planning.feature_sets(t.table(spark, sf, "lineitem").select(F.expr(NAMES.replace("VARCHAR", "STRING")).alias("name")))


@query("f44_luma_weights", "SELECT l_orderkey, l_linenumber, round(pow(2, least(greatest(0.015 * (l_partkey % 1024) - 7.5, -3), 6) / 3), 6) AS at10, round(pow(2, least(greatest(0.015 * 4 * (l_partkey % 256) - 7.5, -3), 6) / 3), 6) AS at8 FROM lineitem")
def f44(spark, sf):
    li = t.table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", r6(planning.luma_weight(F.col("l_partkey") % 1024, 10), "at10"), r6(planning.luma_weight(F.col("l_partkey") % 256, 8), "at8"))


RUNGS = f"SELECT title, height, l_orderkey * 8 + l_linenumber AS rung, crf + 0.5 AS crf, l_linenumber = 1 AS top, quality AS predicted, quality - cpu AS measured FROM ({PROBE})"


@query("m14_calibrated", f"""WITH {ONE}, ru AS (SELECT title, height, rung, crf::DOUBLE AS crf, top, predicted, measured FROM ({RUNGS})),
x AS (SELECT title, height, row_number() OVER w AS i, lag(crf) OVER w AS c0, lag(quality) OVER w AS q0, crf AS c1, quality AS q1 FROM one WINDOW w AS (PARTITION BY title, height ORDER BY crf, quality)),
sl AS (SELECT d.*, coalesce((q1 - q0) / (c1 - c0), 0) AS slope FROM (SELECT DISTINCT title, height, rung, crf FROM ru) d LEFT JOIN x ON x.title = d.title AND x.height = d.height AND i > 1 QUALIFY row_number() OVER (PARTITION BY d.title, d.height, rung, crf ORDER BY coalesce(c1 < crf, false), CASE WHEN c1 < crf THEN -i ELSE i END) = 1), s AS (SELECT * FROM ru JOIN sl USING (title, height, rung, crf)),
n AS (SELECT *, CASE WHEN abs(measured - predicted) > CASE WHEN top THEN 0.5 ELSE 1.5 END AND slope < 0 THEN least(greatest(round((crf + (predicted - measured) / slope) / 0.5) * 0.5, 0), 51) ELSE crf END AS next_crf FROM s)
SELECT title, rung, next_crf, next_crf <> crf AS calibrated FROM n""")
def m14(spark, sf):
    p = probes(spark, sf)
    ru = p.select("title", "height", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rung"), (F.col("crf") + 0.5).alias("crf"), (F.col("l_linenumber") == 1).alias("top"), F.col("quality").alias("predicted"), (F.col("quality") - F.col("cpu")).alias("measured"))
    one = p.groupBy("title", "height", "crf").agg(F.max("quality").alias("quality"))
    return planning.calibrated(ru, one, 0.5, 0.0, 51.0)


def _value(s: str, x: str) -> str:
    return f"CASE WHEN {s}.b1 IS NULL THEN {s}.q0 ELSE {s}.q0 + (ln({x}) - ln({s}.b0)) / (ln({s}.b1) - ln({s}.b0)) * ({s}.q1 - {s}.q0) END"


def _on(s: str, x: str) -> str:
    return f"{s}.title = k.title AND {s}.height = k.height AND {x} >= {s}.b0 AND ({x} < {s}.b1 OR ({s}.b1 IS NULL AND {x} = {s}.b0))"


@query("j12_challengers", f"""WITH {B}, cu AS (SELECT title, height, bitrate, max(vmaf) OVER (PARTITION BY title, height ORDER BY bitrate) AS fitted FROM pb),
sg AS (SELECT title, height, bitrate AS b0, fitted AS q0, lead(bitrate) OVER w AS b1, lead(fitted) OVER w AS q1 FROM cu WINDOW w AS (PARTITION BY title, height ORDER BY bitrate)),
lo AS (SELECT title, height, min(bitrate) AS low, min(fitted) AS top FROM cu GROUP BY ALL), nx AS (SELECT cu.title, cu.height, min(bitrate) AS l1, min(fitted) AS u1 FROM cu JOIN lo USING (title, height) WHERE fitted > top GROUP BY ALL),
k AS (SELECT ru.*, lo.height AS challenger, low, top, coalesce(top + (ln(rate) - ln(low)) * (u1 - top) / (ln(l1) - ln(low)), 0) AS drawn FROM (SELECT DISTINCT title, height, bitrate * 9 // 10 AS rate FROM pb) ru JOIN lo ON lo.title = ru.title AND lo.height > ru.height AND rate < low LEFT JOIN nx ON nx.title = lo.title AND nx.height = lo.height)
SELECT k.title, k.height, k.rate, challenger FROM k LEFT JOIN sg a ON {_on("a", "low")} LEFT JOIN sg c ON {_on("c", "rate")} WHERE coalesce({_value("a", "low")} < top, true) AND coalesce(drawn > {_value("c", "rate")}, true)""")
def j12(spark, sf):
    p = t.probes(spark, sf)
    cu = p.select("title", "height", "bitrate", F.max("vmaf").over(Window.partitionBy("title", "height").orderBy("bitrate")).alias("fitted"))
    return planning.challengers(p.select("title", "height", F.expr("bitrate * 9 div 10").alias("rate")), cu)


BENT = f"b AS (SELECT *, 24.0::DOUBLE AS low, 30.0::DOUBLE AS high, crf - 27 AS d FROM one WHERE rate > 0), f AS (SELECT *, coalesce(count(*) OVER (PARTITION BY title, height ORDER BY abs(d), crf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM b), u AS (SELECT * FROM f WHERE abs(d) <= high - low OR held < 3)"


@query("m17_title_bend", f"""WITH {ONE}, {BENT}, g AS (SELECT title, height, count(*) AS n, sum(d) AS s1, sum(d * d) AS s2, sum(d * d * d) AS s3, sum(d * d * d * d) AS s4, sum(ln(rate)) AS r0, sum(ln(rate) * d) AS r1, sum(ln(rate) * d * d) AS r2, sum(quality) AS q0, sum(quality * d) AS q1, sum(quality * d * d) AS q2 FROM u GROUP BY ALL),
h AS (SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM g)
SELECT title, height, CASE WHEN n < 3 THEN 0.0::DOUBLE ELSE round((n * (s2 * r2 - r1 * s3) - s1 * (s1 * r2 - r1 * s2) + r0 * (s1 * s3 - s2 * s2)) / det + 1e-9, 5) END AS rate_bend, CASE WHEN n < 3 THEN 0.0::DOUBLE ELSE round((n * (s2 * q2 - q1 * s3) - s1 * (s1 * q2 - q1 * s2) + q0 * (s1 * s3 - s2 * s2)) / det + 1e-9, 5) END AS quality_bend FROM h""")
def m17(spark, sf):
    one = probes(spark, sf).groupBy("title", "height", "crf").agg(F.max("rate").alias("rate"), F.max("quality").alias("quality")).withColumns({"low": F.lit(24.0), "high": F.lit(30.0)})
    return planning.title_bend(one).select("title", "height", *[r6(F.col(c) + F.when(F.col(c) != 0, 1e-9).otherwise(0.0), c, 5) for c in ("rate_bend", "quality_bend")])


@query("u3_merged_clips", "SELECT l_orderkey AS clip, min((l_linenumber - 1) * 50) AS first, max(l_linenumber * 50) AS stop, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS decoded FROM lineitem GROUP BY 1")
def u3_clips(spark, sf):
    i = F.col("l_linenumber")
    return planning.merged_clips(t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("clip"), i.alias("segment"), ((i - 1) * 50).alias("first"), (i * 50).alias("stop"), F.col("l_quantity").cast("int").alias("decoded")))


@query("u3_merged_frames", "SELECT l_orderkey AS clip, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, k, l_quantity + k) - 1 AS place, CAST(l_quantity + k AS DOUBLE) AS score FROM lineitem, range(0, 3) r(k)")
def u3_frames(spark, sf):
    k = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("frame")
    f = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("clip"), F.col("l_linenumber").alias("segment"), "l_quantity", k)
    return planning.merged_frames(f.select("clip", "segment", "frame", (F.col("l_quantity") + F.col("frame")).cast("double").alias("score")))


MEANS = "SELECT l_orderkey AS encode, CASE l_linenumber % 3 WHEN 0 THEN 'metric' WHEN 1 THEN 'device' ELSE 'other' END AS kind, l_returnflag AS name, CAST(l_linenumber AS BIGINT) AS n FROM lineitem"


@query("x5_measurements", f"""WITH m AS (SELECT encode, kind, name, max(n) AS mean FROM ({MEANS}) GROUP BY ALL), g AS (SELECT encode, string_agg(name || '=' || mean, ',' ORDER BY name) FILTER (kind = 'metric') AS metrics, string_agg(name || '=' || mean, ',' ORDER BY name) FILTER (kind = 'device') AS devices FROM m GROUP BY 1)
SELECT o_orderkey AS encode, o_totalprice AS quality, metrics, devices FROM orders LEFT JOIN g ON encode = o_orderkey""")
def x5(spark, sf):
    m = rows(spark, sf, MEANS).groupBy("encode", "kind", "name").agg(F.max("n").alias("mean"))
    e = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("encode"), F.col("o_totalprice").alias("quality"))
    flat = lambda c: F.when(F.col(c).isNotNull(), F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))), ",")).alias(c)
    return planning.measurement(e, m).select("encode", "quality", flat("metrics"), flat("devices"))
