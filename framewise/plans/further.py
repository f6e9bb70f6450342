"""Registered queries of streams, probing and segments. See registry.py for the common tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import media
from ..operators import probing, segments
from . import tables as t
from .registry import query, r6

# lineitem in the roles of probes, rungs, frames and titles
PROBE = "SELECT l_partkey AS title, CASE l_linenumber % 3 WHEN 0 THEN 360 WHEN 1 THEN 720 ELSE 1080 END AS height, 18.0 + l_linenumber * 3 + l_orderkey % 4 * 0.5 AS crf, round(CAST(l_extendedprice AS DOUBLE)) AS rate, CAST(l_quantity AS DOUBLE) + 45 AS quality, CAST(l_discount AS DOUBLE) * 100 AS cpu, l_linestatus = 'F' AS predicted, l_orderkey, l_linenumber FROM lineitem"


def rows(spark, sf, sql: str) -> DataFrame:
    """A select over lineitem or orders."""
    head, name = sql.rsplit(" FROM ", 1)
    where = name.split(" WHERE ", 1)
    d = t.table(spark, sf, where[0].strip())
    if len(where) > 1:
        d = d.where(where[1])
    distinct = head.startswith("SELECT DISTINCT ")
    from .wider import _columns

    d = d.selectExpr(*_columns(head[len("SELECT DISTINCT ") if distinct else len("SELECT ") :]))
    return d.distinct() if distinct else d


def probes(spark, sf) -> DataFrame:
    return rows(spark, sf, PROBE).withColumn("crf", F.col("crf").cast("double"))


# ---- streams --------------------------------------------------------------------------------------------------
STREAM = "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'smpte2084' WHEN 1 THEN 'arib-std-b67' ELSE 'bt709' END AS transfer, CASE l_returnflag WHEN 'A' THEN 'pc' WHEN 'R' THEN 'jpeg' ELSE 'tv' END AS colour_range, CASE WHEN l_linenumber > 4 THEN 5 ELSE NULL END AS dolby, l_linenumber % 2 AS compat, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS d, CAST(l_tax AS DOUBLE) AS x FROM lineitem"


@query("f4_hdr_predicates", f"SELECT l_orderkey, l_linenumber, transfer IN ('smpte2084', 'arib-std-b67') AS hdr, colour_range IN ('pc', 'jpeg') AS full_range, transfer IN ('smpte2084', 'arib-std-b67') AND (dolby IS NULL OR compat <> 0) AS measurable FROM ({STREAM})")
def f4(spark, sf):
    return rows(spark, sf, STREAM).select("l_orderkey", "l_linenumber", media.is_hdr(F.col("transfer")).alias("hdr"), media.full_range(F.col("colour_range")).alias("full_range"), media.measurable_hdr(F.col("transfer"), F.col("dolby"), F.col("compat")).alias("measurable"))


NAMES = "CASE l_linenumber WHEN 1 THEN 'EBU' WHEN 2 THEN ' atsc ' WHEN 3 THEN '' WHEN 4 THEN '-18.5 LUFS' WHEN 5 THEN '-71' WHEN 6 THEN 'loud' ELSE 'streaming-14' END"


@query("f11_loudness_targets", f"""WITH x AS (SELECT l_orderkey, l_linenumber, lower(trim({NAMES})) AS s FROM lineitem), y AS (SELECT *, try_cast(trim(regexp_replace(s, 'lufs$', '')) AS DOUBLE) AS n FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN s IN ('', 'ebu') THEN 'ebu' WHEN s IN ('ebu-live', 'atsc', 'streaming', 'streaming-14') THEN s WHEN n BETWEEN -70 AND 0 THEN 'custom' END AS name,
CASE WHEN s IN ('', 'ebu', 'ebu-live') THEN -23.0::DOUBLE WHEN s = 'atsc' THEN -24.0 WHEN s = 'streaming' THEN -16.0 WHEN s = 'streaming-14' THEN -14.0 WHEN n BETWEEN -70 AND 0 THEN n END AS integrated,
CASE WHEN s IN ('', 'ebu') THEN 0.5::DOUBLE WHEN s = 'atsc' THEN 2.0 WHEN s IN ('ebu-live', 'streaming', 'streaming-14') OR n BETWEEN -70 AND 0 THEN 1.0 END AS tolerance FROM y""")
def f11(spark, sf):
    d = rows(spark, sf, f"SELECT l_orderkey, l_linenumber, {NAMES} AS s FROM lineitem").withColumn("m", media.loudness_target(F.col("s")))
    return d.select("l_orderkey", "l_linenumber", "m.name", "m.integrated", "m.tolerance")


LAYOUT = "CASE l_linenumber % 4 WHEN 0 THEN 'FL+FR' WHEN 1 THEN 'FL+FR+FC+LFE+BL+BR' WHEN 2 THEN 'FL+FR+FC+LFE+BL+BR+SL+SR' ELSE 'FC' END"


@query("f12_channel_weights", f"SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN '1.0,1.0' WHEN 1 THEN '1.0,1.0,1.0,0.0,1.41,1.41' WHEN 2 THEN '1.0,1.0,1.0,0.0,1.0,1.0,1.41,1.41' ELSE '1.0' END AS weights, CASE l_linenumber % 4 WHEN 0 THEN '0/1' WHEN 1 THEN '0/1,4/5' WHEN 2 THEN '0/1,6/7,4/5' ELSE '' END AS pairs FROM lineitem")
def f12(spark, sf):
    c = F.col("s")
    pairs = F.transform(media.stereo_pairs(c), lambda p: F.concat_ws("/", p["left"].cast("string"), p["right"].cast("string")))
    return rows(spark, sf, f"SELECT l_orderkey, l_linenumber, {LAYOUT} AS s FROM lineitem").select("l_orderkey", "l_linenumber", F.array_join(media.channel_weights(c).cast("array<string>"), ",").alias("weights"), F.array_join(pairs, ",").alias("pairs"))


def _pq(x: str) -> str:
    return f"pow((0.8359375 + 18.8515625 * pow(greatest({x}, 0) / 10000, 0.1593017578125)) / (1 + 18.6875 * pow(greatest({x}, 0) / 10000, 0.1593017578125)), 78.84375)"


ITP = f"""rgb AS (SELECT l_orderkey, l_linenumber, q * 20 AS r, d * 5000 AS g, x * 4000 AS b, q * 21 AS r2, d * 4800 AS g2, x * 4100 AS b2 FROM ({STREAM})),
lms AS (SELECT *, {", ".join(f"{_pq(f'({a} * r{n} + {b} * g{n} + {c} * b{n}) / 4096')} AS {k}{n}" for n in ("", "2") for k, (a, b, c) in zip("lms", media.LMS))} FROM rgb)"""


@query("f14_colour_difference", f"WITH {ITP} SELECT l_orderkey, l_linenumber, round(720 * sqrt(pow(((l + m) - (l2 + m2)) / 2, 2) + pow((6610 * (l - l2) - 13613 * (m - m2) + 7003 * (s - s2)) / 8192, 2) + pow((17933 * (l - l2) - 17390 * (m - m2) - 543 * (s - s2)) / 4096, 2)), 4) AS delta_e FROM lms")
def f14(spark, sf):
    q, d, x = F.col("q"), F.col("d"), F.col("x")
    return rows(spark, sf, STREAM).select("l_orderkey", "l_linenumber", r6(media.delta_e_itp((q * 20, d * 5000, x * 4000), (q * 21, d * 4800, x * 4100)), "delta_e", 4))


@query("f20_series", "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'XPSNR Y' WHEN 2 THEN 'CAMBI (banding)' WHEN 3 THEN 'SSIM' WHEN 4 THEN 'ΔE ITP' ELSE 'mine' END AS label, CASE l_linenumber WHEN 1 THEN 'dB' ELSE '' END AS unit, l_linenumber IN (2, 4) AS lower_is_better, CASE WHEN l_linenumber = 3 THEN 4 ELSE 2 END AS decimals, CASE WHEN l_linenumber IN (2, 4) THEN l_quantity + 9 ELSE l_quantity END::DOUBLE AS worst FROM lineitem")
def f20(spark, sf):
    n, q = F.col("s"), F.col("l_quantity").cast("double")
    d = t.table(spark, sf, "lineitem").withColumn("s", F.expr("CASE l_linenumber WHEN 1 THEN 'xpsnr_y' WHEN 2 THEN 'cambi' WHEN 3 THEN 'ssim' WHEN 4 THEN 'delta_e_itp' ELSE 'mine' END"))
    return d.select("l_orderkey", "l_linenumber", media.series_info(n).alias("i"), media.worst(n, q, q + 9).alias("worst")).select("l_orderkey", "l_linenumber", "i.*", "worst")


@query("f26_sample_budgets", "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 0.05::DOUBLE WHEN 2 THEN 0.0 WHEN 5 THEN 1.0 END AS share, CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 5 THEN 0 END AS per_scene FROM lineitem")
def f26(spark, sf):
    d = rows(spark, sf, "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN ' 5%' WHEN 2 THEN '2/Scene' WHEN 3 THEN '0%' WHEN 4 THEN '120 %' WHEN 5 THEN '100 %' WHEN 6 THEN '0/scene' ELSE 'all' END AS s FROM lineitem")
    return d.withColumn("b", media.sample_budget(F.col("s"))).select("l_orderkey", "l_linenumber", "b.share", "b.per_scene")


@query("f27_metric_names", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'psnr,ssim' WHEN 1 THEN 'ssim,cambi' END AS names FROM lineitem")
def f27(spark, sf):
    d = rows(spark, sf, "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN ' SSIM ;vmaf;psnr;ssim' WHEN 1 THEN 'cambi;;ssim' ELSE 'psnr;what' END AS s FROM lineitem")
    return d.select("l_orderkey", "l_linenumber", F.array_join(media.known_names(F.split("s", ";"), ["psnr", "ssim", "cambi"], "vmaf"), ",").alias("names"))


@query("f41_camera_rates", f"SELECT l_orderkey, l_linenumber, round(-(q - 25) / 1920 * 100 / 0.04, 6) + 0.0 AS pan, round(d * 8 / 1920 * 100 / 0.04, 6) + 0.0 AS tilt, round(ln(sqrt(pow(1 + x / 10, 2) + pow(d / 10, 2))) * 100 / 0.04, 6) + 0.0 AS zoom, round(-atan2(d / 10, 1 + x / 10) * 180 / pi() / 0.04, 6) + 0.0 AS roll FROM ({STREAM})")
def f41(spark, sf):
    q, d, x = F.col("q"), F.col("d"), F.col("x")
    got = media.camera_rates(q - 25, d * 8, x / 10, d / 10, F.lit(0.04), F.lit(1920.0))
    return rows(spark, sf, STREAM).select("l_orderkey", "l_linenumber", *[(F.round(c, 6) + 0.0).alias(k) for k, c in got.items()])


@query("x26_steady_rate", f"SELECT l_orderkey, l_linenumber, CASE WHEN abs((24 + d * 10) / 25 - 1) <= 0.02 THEN 25.0 ELSE round(24 + d * 10, 6) END AS rate FROM ({STREAM})")
def x26(spark, sf):
    return rows(spark, sf, STREAM).select("l_orderkey", "l_linenumber", r6(media.steady_rate(F.lit(25.0), 24 + F.col("d") * 10), "rate"))


@query("x31_raw_series", f"SELECT l_orderkey, l_linenumber, round(sqrt(1920 * 1080 * pow(255, 2) / pow(10, q / 10)), 3) AS luma, round(sqrt(960 * 540 * pow(1023, 2) / pow(10, q / 10)), 3) AS chroma FROM ({STREAM})")
def x31(spark, sf):
    w, h, q = F.lit(1920), F.lit(1080), F.col("q")
    return rows(spark, sf, STREAM).select("l_orderkey", "l_linenumber", r6(media.xpsnr_raw(q, w, h, F.lit(8)), "luma", 3), r6(media.xpsnr_raw(q, w, h, F.lit(10), False), "chroma", 3))


# ---- probing --------------------------------------------------------------------------------------------------
CURVES = f"cv AS (SELECT title, height AS h, min(rate) AS lo, max(rate) AS hi FROM ({PROBE}) GROUP BY ALL)"
RUNGS = "ru AS (SELECT l_partkey AS title, l_orderkey * 8 + l_linenumber AS rung, round(CAST(l_extendedprice AS DOUBLE)) * 1.1 AS rate, CASE l_linenumber % 2 WHEN 0 THEN 540 ELSE 1080 END AS height FROM lineitem)"


@query("j10_curve_of_rung", f"""WITH {CURVES}, {RUNGS} SELECT title, rung, rate, height, h AS curve FROM ru JOIN cv USING (title)
QUALIFY row_number() OVER (PARTITION BY title, rung, rate, height ORDER BY CASE WHEN h <= height AND rate BETWEEN lo AND hi THEN 0 WHEN h <= height THEN 1 ELSE 2 END, CASE WHEN h <= height THEN -h ELSE h END) = 1""")
def j10(spark, sf):
    curves = probes(spark, sf).groupBy("title", "height").agg(F.min("rate").alias("low"), F.max("rate").alias("high"))
    rungs = t.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("title"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rung"), (F.round(F.col("l_extendedprice").cast("double")) * 1.1).alias("rate"), F.expr("CASE l_linenumber % 2 WHEN 0 THEN 540 ELSE 1080 END").alias("height"))
    return probing.curve_for(rungs, curves)


JOBS = "SELECT l_partkey AS title, 360 AS height, 18.0 + l_linenumber * 2 + l_orderkey % 3 * 0.2 AS crf FROM lineitem"


def jobs(spark, sf) -> DataFrame:
    return rows(spark, sf, JOBS).withColumn("crf", F.col("crf").cast("double")).distinct()


@query("j13_not_probed", f"SELECT title, height, crf::DOUBLE AS crf FROM (SELECT DISTINCT * FROM ({JOBS})) j WHERE NOT EXISTS (SELECT 1 FROM ({PROBE}) p WHERE p.title = j.title AND p.height = j.height AND abs(j.crf::DOUBLE - p.crf::DOUBLE) < 0.25)")
def j13_tolerance(spark, sf):
    return probing.not_probed(jobs(spark, sf), probes(spark, sf))


GRID_JOBS = "SELECT DISTINCT l_partkey AS title, 720 AS height, 18.0 + l_linenumber * 3 AS crf FROM lineitem"


@query("m9_next_free", f"""WITH j AS (SELECT title, height, crf::DOUBLE AS crf FROM ({GRID_JOBS})), p AS (SELECT DISTINCT title, height, crf::DOUBLE AS crf FROM ({PROBE}))
SELECT j.title, j.height, j.crf + min(k) * 0.5 AS crf FROM j, range(0, 60) r(k) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.title = j.title AND p.height = j.height AND p.crf = j.crf + k * 0.5) GROUP BY j.title, j.height, j.crf HAVING j.crf + min(k) * 0.5 <= 40""")
def m9_free(spark, sf):
    return probing.next_free(rows(spark, sf, GRID_JOBS).withColumn("crf", F.col("crf").cast("double")), probes(spark, sf), 0.5, 40.0)


@query("x9_crf_ranges", f"SELECT title, height, min(crf)::DOUBLE AS low, max(crf)::DOUBLE AS high FROM ({PROBE}) GROUP BY ALL")
def x9(spark, sf):
    return probing.crf_ranges(probes(spark, sf))


@query("x11_probe_plan", f"""WITH r AS (SELECT title, height, round(min(crf)::DOUBLE - 2) AS lo, round(max(crf)::DOUBLE + 2) AS hi FROM ({PROBE}) GROUP BY ALL), g AS (SELECT *, CAST(greatest(1, ceil((hi - lo) / 6 - 1e-9)) AS INT) AS n FROM r)
SELECT DISTINCT title, height, round(lo + (hi - lo) * k / n) AS crf FROM g, LATERAL (SELECT unnest(range(0, n + 1)) AS k)""")
def x11(spark, sf):
    r = probing.crf_ranges(probes(spark, sf))
    return r.select("title", "height", F.explode(probing.probe_plan(F.col("low"), F.col("high"), 2.0)).alias("crf"))


LEVELS = f"SELECT DISTINCT title, crf AS level, crf + 1 AS high FROM ({PROBE})"


@query("x12_levels", f"""WITH lv AS (SELECT DISTINCT title, crf::DOUBLE AS level, crf::DOUBLE + 1 AS high FROM ({PROBE})), r AS (SELECT l_partkey AS title, l_orderkey * 8 + l_linenumber AS id, CAST(l_quantity AS DOUBLE) AS crf FROM lineitem)
SELECT title, id, crf, level FROM r JOIN lv USING (title) QUALIFY row_number() OVER (PARTITION BY title, id, crf ORDER BY crf > high, CASE WHEN crf <= high THEN high ELSE -high END) = 1""")
def x12(spark, sf):
    lv = probes(spark, sf).select("title", F.col("crf").alias("level"), (F.col("crf") + 1).alias("high")).distinct()
    r = t.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("title"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("double").alias("crf"))
    return probing.level_at(r, lv)


ONE = f"one AS (SELECT title, height, crf::DOUBLE AS crf, max(rate) AS rate, max(quality) AS quality FROM ({PROBE}) GROUP BY ALL)"


@query("x13_probe_pairs", f"""WITH {ONE}, x AS (SELECT *, lead(crf) OVER w AS c1, lead(rate) OVER w AS r1, lead(quality) OVER w AS q1 FROM one WINDOW w AS (PARTITION BY title, height ORDER BY crf))
SELECT title, height, crf AS low, c1 AS high, round((q1 - quality) / (c1 - crf), 6) AS quality_slope, round((ln(r1) - ln(rate)) / (c1 - crf), 6) AS rate_slope FROM x WHERE c1 IS NOT NULL""")
def x13(spark, sf):
    one = probes(spark, sf).groupBy("title", "height", "crf").agg(F.max("rate").alias("rate"), F.max("quality").alias("quality"))
    return probing.probe_pairs(one).select("title", "height", "low", "high", r6("quality_slope", "quality_slope"), r6("rate_slope", "rate_slope"))


CHUNKS = "SELECT l_suppkey AS title, l_linenumber AS rung, l_orderkey AS chunk, l_linenumber * 16 + l_orderkey % 7 AS width, l_orderkey % 5 * 90 AS height FROM lineitem"


@query("x17_declared_geometry", f"SELECT title, rung, width, height FROM ({CHUNKS}) QUALIFY row_number() OVER (PARTITION BY title, rung ORDER BY height DESC, chunk, width) = 1")
def x17(spark, sf):
    return probing.declared_geometry(rows(spark, sf, CHUNKS))


@query("a31_encode_costs", f"SELECT title, height, round(avg(cpu), 6) AS cpu FROM (SELECT title, height, cpu FROM ({PROBE}) WHERE NOT predicted UNION ALL SELECT title, height, cpu * 2 FROM ({PROBE})) WHERE cpu > 0 GROUP BY ALL")
def a31(spark, sf):
    p = probes(spark, sf)
    return probing.encode_costs(p, p.withColumn("cpu", F.col("cpu") * 2)).select("title", "height", r6("cpu", "cpu"))


STEP = f"SELECT l_orderkey, l_linenumber, 23.0 AS before, 94.0 AS q0, 18.0 + l_linenumber AS crf, q + 50 AS quality FROM ({STREAM})"


@query("m15_top_step", f"""WITH s AS (SELECT l_orderkey, l_linenumber, 23.0::DOUBLE AS b, (18 + l_linenumber)::DOUBLE AS c, q + 50 AS v FROM ({STREAM})), x AS (SELECT *, (v - 94) / nullif(c - b, 0) AS slope FROM s), n AS (SELECT *, round(c + (95 - v) / nullif(slope, 0)) AS nx FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN slope IS NULL OR slope >= 0 OR nx = c THEN c ELSE nx END AS crf, CASE WHEN slope IS NULL OR slope >= 0 OR nx = c THEN 'keep' WHEN nx = b THEN 'restore' ELSE 'encode' END AS action FROM n""")
def m15(spark, sf):
    crf, action = probing.top_step(F.lit(23.0), F.lit(94.0), (F.lit(18) + F.col("l_linenumber")).cast("double"), F.col("q") + 50, 95.0)
    return rows(spark, sf, STREAM).select("l_orderkey", "l_linenumber", crf.alias("crf"), action.alias("action"))


@query("x20_keep_per_shot", f"SELECT l_orderkey, l_linenumber, d > 0.05 AS kept FROM ({STREAM})")
def x20(spark, sf):
    return rows(spark, sf, STREAM).select("l_orderkey", "l_linenumber", probing.keep_per_shot(F.col("d") * 100 - 5).alias("kept"))


DESIGNS = "SELECT l_partkey AS model, l_orderkey * 8 + l_linenumber AS position, l_linenumber AS anchors, CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_discount AS DOUBLE) * 20 END AS error FROM lineitem"


@query("m26_design_choice", f"SELECT model, position, anchors, error FROM ({DESIGNS}) QUALIFY row_number() OVER (PARTITION BY model ORDER BY NOT coalesce(error <= 0.5, false), error IS NULL, CASE WHEN coalesce(error <= 0.5, false) THEN anchors ELSE 0 END, coalesce(error, -anchors), position) = 1")
def m26(spark, sf):
    return probing.choose_design(rows(spark, sf, DESIGNS), 0.5)


@query("j16_regressors", f"""WITH a AS (SELECT title, height, crf::DOUBLE AS crf, ln(rate / (height * height * 16 / 9.0)) AS x, ln(least(quality, 99.5) / (100 - least(quality, 99.5))) AS z FROM ({PROBE}))
SELECT title, round(max(x) FILTER (height = 720 AND crf = 21), 6) AS x0, round(max(z) FILTER (height = 720 AND crf = 21), 6) AS z0, round(max(x) FILTER (height = 1080 AND crf = 24.5), 6) AS x1, round(max(z) FILTER (height = 1080 AND crf = 24.5), 6) AS z1 FROM a GROUP BY 1 HAVING x0 IS NOT NULL AND x1 IS NOT NULL""")
def j16(spark, sf):
    p = probes(spark, sf).withColumn("width", F.col("height") * 16 / 9)
    got = probing.regressors(p.select("title").distinct(), p, [(720, 21.0), (1080, 24.5)])
    return got.select("title", *[r6(c, c) for c in ("x0", "z0", "x1", "z1")])


@query("j17_rendition_gaps", "WITH r AS (SELECT o_custkey AS title, o_orderkey % 5 AS rung, avg(o_totalprice) AS predicted FROM orders GROUP BY ALL) SELECT title, o_orderkey AS rendition, rung, round(o_totalprice / predicted - 1, 6) AS gap, abs(o_totalprice / predicted - 1) > 0.10 AS off FROM orders JOIN r ON title = o_custkey AND rung = o_orderkey % 5")
def j17(spark, sf):
    o = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("title"), F.col("o_orderkey").alias("rendition"), (F.col("o_orderkey") % 5).alias("rung"), F.col("o_totalprice").alias("rate"))
    return probing.rendition_gaps(o, o.groupBy("title", "rung").agg(F.avg("rate").alias("rate"))).withColumn("gap", F.round("gap", 6))


@query("m18_blended_models", "SELECT l_suppkey AS title, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS a, round(sum(l_quantity * l_tax) / sum(l_quantity), 6) AS b FROM lineitem GROUP BY 1")
def m18(spark, sf):
    d = t.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("title"), F.col("l_quantity").cast("double").alias("weight"), F.col("l_discount").cast("double").alias("a"), F.col("l_tax").cast("double").alias("b"))
    return probing.blended(d, ["a", "b"]).select("title", r6("a", "a"), r6("b", "b"))


@query("u2_all_probes", f"SELECT DISTINCT title, height, crf::DOUBLE AS crf FROM (SELECT title, height, crf FROM ({PROBE}) UNION ALL SELECT title, height, crf FROM ({JOBS}) UNION ALL SELECT title, height, crf FROM ({GRID_JOBS}))")
def u2(spark, sf):
    c = ["title", "height", F.col("crf").cast("double").alias("crf")]
    return probes(spark, sf).select(*c).unionByName(jobs(spark, sf).select(*c)).unionByName(rows(spark, sf, GRID_JOBS).select(*c)).distinct()


@query("u6_held_out", "SELECT DISTINCT l_suppkey AS title, l_suppkey % 5 AS fold FROM lineitem WHERE l_suppkey % 5 <> 2")
def u6(spark, sf):
    return t.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("title"), (F.col("l_suppkey") % 5).alias("fold")).where("fold <> 2").distinct()


@query("u7_distinct_sources", "SELECT l_suppkey AS source, min(l_orderkey * 8 + l_linenumber) AS first FROM lineitem GROUP BY 1")
def u7(spark, sf):
    return t.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("source")).agg(F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("first"))


# ---- segments -------------------------------------------------------------------------------------------------
@query("a27_log_rates", f"SELECT l_orderkey, l_linenumber, round(ln((q * 1000 + 1) / ((10 + l_linenumber) / 25.0) / 129600), 6) AS bits FROM ({STREAM})")
def a27(spark, sf):
    return rows(spark, sf, STREAM).select("l_orderkey", "l_linenumber", r6(segments.log_rate(F.col("q") * 1000, F.lit(10) + F.col("l_linenumber"), 25.0, 129600.0), "bits"))


FRAMES = "SELECT l_suppkey AS title, CAST((l_orderkey * 8 + l_linenumber) % 997 AS INT) AS frame, CAST(l_quantity AS DOUBLE) + 45 AS score FROM lineitem"


@query("x21_segment_scores", f"""WITH f AS ({FRAMES}), ti AS (SELECT DISTINCT title, 150 AS n FROM f), e AS (SELECT title, CAST(s AS INT) AS segment FROM ti, range(0, 150) r(s)),
g AS (SELECT title, frame // 6 AS segment, avg(score) AS m FROM f GROUP BY ALL), w AS (SELECT title, avg(score) AS a FROM f GROUP BY 1), v AS (SELECT title, segment, least(greatest(coalesce(m, a), 0.5), 99.5) AS v FROM e LEFT JOIN g USING (title, segment) JOIN w USING (title))
SELECT title, segment, round(ln(v / (100 - v)), 6) AS score FROM v""")
def x21(spark, sf):
    f = rows(spark, sf, FRAMES)
    return segments.segment_scores(f, f.select("title").distinct().withColumn("segments", F.lit(150)), 6).select("title", "segment", r6("score", "score"))


@query("x22_segment_quantisers", "WITH f AS (SELECT l_suppkey AS title, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1 AS frame, l_quantity AS qp FROM lineitem) SELECT title, frame // 25 AS segment, round(avg(qp), 6) AS qp, count(*) = 25 AS whole FROM f GROUP BY ALL")
def x22(spark, sf):
    li = t.table(spark, sf, "lineitem")
    f = li.select(F.col("l_suppkey").alias("title"), (F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_extendedprice")) - 1).cast("long").alias("frame"), F.col("l_quantity").cast("double").alias("qp"))
    return segments.segment_means(f, 25).withColumn("qp", F.round("qp", 6))


@query("x23_scale_loss", "SELECT l_suppkey AS title, (l_orderkey % 500) * 10 // 48 AS segment, round(avg(least(l_quantity::DOUBLE + 20, 60)), 6) AS loss FROM lineitem GROUP BY ALL")
def x23(spark, sf):
    f = t.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("title"), (F.col("l_orderkey") % 500).alias("k"), (F.col("l_quantity").cast("double") + 20).alias("psnr"))
    return segments.scale_loss(f, 48).withColumn("loss", F.round("loss", 6))


CUTS = "SELECT l_orderkey AS title, l_linenumber AS idx, l_linenumber * 10 + CAST(l_quantity AS DOUBLE) / 12 AS start, l_linenumber * 10 + CAST(l_quantity AS DOUBLE) / 12 + 8 AS stop, 80.0 AS duration FROM lineitem"


@query("x28_snapped_to_gops", f"""WITH c AS (SELECT title, idx, start, stop, greatest(round(start * 25.0 / 48) * 48 / 25.0 - 0.01, 0) AS a, stop - start AS len FROM ({CUTS})), x AS (SELECT *, a + len > 80 OR coalesce(a < lag(a + len) OVER (PARTITION BY title ORDER BY idx), false) AS bad FROM c), y AS (SELECT *, bool_or(bad) OVER (PARTITION BY title) AS b FROM x)
SELECT title, idx, round(CASE WHEN b THEN start ELSE a END, 6) AS start, round(CASE WHEN b THEN stop ELSE a + len END, 6) AS stop FROM y""")
def x28(spark, sf):
    return segments.snapped_to_gops(rows(spark, sf, CUTS), 48, 25.0).select("title", "idx", r6("start", "start"), r6("stop", "stop"))


BANDED = "SELECT l_suppkey AS title, l_linenumber AS clip, l_orderkey AS frame, CAST(l_quantity AS DOUBLE) / 8 AS cambi FROM lineitem"


@query("x29_banded_clips", f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY title, clip ORDER BY frame) AS i FROM (SELECT title, clip, frame, max(cambi) AS cambi FROM ({BANDED}) GROUP BY ALL)), b AS (SELECT *, i - row_number() OVER (PARTITION BY title, clip ORDER BY frame) AS run FROM n WHERE cambi > 5)
SELECT title, clip, min(frame) AS first, max(frame) + 1 AS stop FROM b GROUP BY title, clip, run""")
def x29(spark, sf):
    return segments.banded_clips(rows(spark, sf, BANDED).groupBy("title", "clip", "frame").agg(F.max("cambi").alias("cambi")))


@query("x40_spread", "WITH i AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders) SELECT DISTINCT o_custkey, o_orderkey FROM i, range(0, 6) r(j) WHERE c <= 6 OR i = j * c // 6")
def x40(spark, sf):
    return segments.spread(t.table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], 6)


@query("m35_excerpts", "WITH o AS (SELECT o_orderkey AS title, 100 + o_orderkey % 900 AS total FROM orders), n AS (SELECT *, least(4, total // 120) AS n FROM o), p AS (SELECT title, i, floor(i * (total / n) + ((total / n) - 120) / 2) AS first FROM n, LATERAL (SELECT unnest(range(0, n)) AS i)) SELECT title, CAST(i AS INT) AS i, round(greatest((first - 0.25) / 25, 0), 6) AS start, round(greatest((first - 0.25) / 25, 0) + 4.8, 6) AS stop FROM p")
def m35(spark, sf):
    o = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("title"), (F.lit(100) + F.col("o_orderkey") % 900).alias("total"), F.lit(25.0).alias("rate"))
    return segments.placed(o, 120, 4).select("title", "i", r6("start", "start"), r6("stop", "stop"))


PROGRAM = "SELECT l_suppkey AS program, l_orderkey AS frame, l_linenumber * 100 AS bytes, CAST(l_quantity AS DOUBLE) AS score FROM lineitem"


@query("a37_title_measures", f"""WITH f AS ({PROGRAM}), sp AS (SELECT DISTINCT program, i AS title, i * 1000 AS first, (i + 1) * 1000 AS stop FROM f, range(0, 8) r(i)),
b AS (SELECT sp.program, title, CAST(round(sum(bytes) * 8 * 25.0 / count(*)) AS BIGINT) AS bitrate FROM f JOIN sp ON f.program = sp.program AND frame >= first AND frame < stop GROUP BY ALL),
q AS (SELECT sp.program, title, count(*) AS scored, avg(score) AS quality FROM f JOIN sp ON f.program = sp.program AND frame >= first AND frame < stop AND frame % 2 = 0 GROUP BY ALL)
SELECT program, title, coalesce(bitrate, 0) AS bitrate, coalesce(scored, 0) AS scored, round(coalesce(quality, 0), 6) AS quality FROM sp LEFT JOIN b USING (program, title) LEFT JOIN q USING (program, title)""")
def a37(spark, sf):
    f = rows(spark, sf, PROGRAM)
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))
    sp = f.select("program").distinct().withColumn("title", i).withColumns({"first": F.col("title") * 1000, "stop": (F.col("title") + 1) * 1000})
    return segments.title_measurements(f, f.where("frame % 2 = 0"), sp, 25.0).withColumn("quality", F.round("quality", 6))


SCENES = "SELECT l_suppkey AS title, l_orderkey AS source, l_linenumber AS segment, CASE l_linenumber % 3 WHEN 0 THEN 'top' WHEN 1 THEN 'easy' ELSE 'representative' END AS kind, CAST(l_quantity AS DOUBLE) AS score FROM lineitem"


@query("t7_scene_order", f"SELECT title, source, segment, kind, score, CAST(row_number() OVER (PARTITION BY title ORDER BY kind NOT IN ('top', 'easy'), CASE kind WHEN 'easy' THEN score WHEN 'top' THEN -score ELSE 0 END, source, segment, score) AS INT) AS place FROM ({SCENES})")
def t7(spark, sf):
    return segments.scene_order(rows(spark, sf, SCENES))


@query("j18_rest_of_pool", "WITH x AS (SELECT l_suppkey AS title, l_orderkey * 8 + l_linenumber AS first, l_quantity > 25 AND l_returnflag = 'N' AS picked FROM lineitem) SELECT title, first FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.picked AND y.title = x.title AND y.first = x.first)")
def j18(spark, sf):
    li = t.table(spark, sf, "lineitem")
    pool = li.select(F.col("l_suppkey").alias("title"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("first"))
    picked = li.where("l_quantity > 25 AND l_returnflag = 'N'").select(F.col("l_suppkey").alias("title"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("first"))
    return segments.rest_of_pool(pool, picked)


@query("x41_overlay_track", "SELECT l_orderkey AS title, l_linenumber AS track FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'R', l_linenumber) = 1")
def x41(spark, sf):
    tr = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("title"), F.col("l_linenumber").alias("track"), F.col("l_linenumber").alias("position"), (F.col("l_returnflag") == "R").alias("is_default"))
    return segments.overlay_track(tr)


@query("a23_exact_mean", "SELECT l_suppkey AS title, round(avg(l_quantity), 6) AS mean, count(*) AS frames, 0.0::DOUBLE AS half_width FROM lineitem GROUP BY 1")
def a23(spark, sf):
    f = t.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("title"), F.col("l_quantity").cast("double").alias("score"))
    return segments.exact_mean(f).withColumn("mean", F.round("mean", 6))
