"""Registered queries of pixel, audio and planning kernels, and of the ladder's arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import dsp, pixels, plan, seq
from . import tables as t
from .registry import B, P, query, r6

WIDTH = 8
LUMA = "fr AS (SELECT CAST(label AS BIGINT) AS video_id, vec_id AS pos, list_transform(embedding, lambda x: least(255, greatest(0, floor((x::DOUBLE + 0.5) * 255)))) AS luma FROM embeddings)"


def frames(spark, sf) -> DataFrame:
    """Embeddings as frames of 8 pixels a row, in order of vec_id within a label."""
    luma = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((x.cast("double") + 0.5) * 255).cast("double"))))
    e = t.table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("video_id"), F.col("vec_id").alias("pos"), luma.alias("luma"))
    return e.withColumn("before", F.lag("luma").over(Window.partitionBy("video_id").orderBy("pos")))


@query("f32_dark_share", f"WITH {LUMA} SELECT video_id, pos, round(len(list_filter(luma, lambda v: v <= 120)) / len(luma), 6) AS dark FROM fr")
def f32(spark, sf):
    return frames(spark, sf).select("video_id", "pos", r6(pixels.dark_share(F.col("luma"), 120.0), "dark"))


@query("f35_luma_stats", f"WITH {LUMA} SELECT video_id, pos, round(list_avg(luma), 6) AS mean, list_min(luma) AS low, list_max(luma) AS high, round(len(list_filter(luma, lambda v: v < 90 OR v > 160)) / len(luma), 6) AS out FROM fr")
def f35(spark, sf):
    s = frames(spark, sf).select("video_id", "pos", pixels.luma_stats(F.col("luma"), 90, 160).alias("s"))
    return s.select("video_id", "pos", r6("s.mean", "mean"), F.col("s.min").alias("low"), F.col("s.max").alias("high"), r6("s.out", "out"))


@query("f31_downscaled", f"WITH {LUMA}, x AS (SELECT video_id, pos, r, c, luma[1 + r * 32 + c * 4:4 + r * 32 + c * 4] || luma[9 + r * 32 + c * 4:12 + r * 32 + c * 4] || luma[17 + r * 32 + c * 4:20 + r * 32 + c * 4] || luma[25 + r * 32 + c * 4:28 + r * 32 + c * 4] AS v FROM fr, range(0, 2) a(r), range(0, 2) b(c)) SELECT video_id, pos, CAST(r * 2 + c AS BIGINT) AS cell, round(list_avg(v), 4) AS mean FROM x")
def f31(spark, sf):
    d = pixels.mapped(frames(spark, sf), WIDTH, "cells array<double>", lambda f, _: {"cells": list(pixels.downscale(f, 4).reshape(len(f), -1))})
    return d.select("video_id", "pos", F.posexplode("cells").alias("cell", "mean")).select("video_id", "pos", F.col("cell").cast("long").alias("cell"), r6("mean", "mean", 4))


@query("f34_spatial_temporal")
def f34(spark, sf):
    return pixels.mapped(frames(spark, sf), WIDTH, "si double, ti double, grain double", lambda f, p: {"si": pixels.spatial_info(f), "ti": pixels.temporal_info(f, p), "grain": pixels.grain_sigma(f)})


@query("f33_content_box", f"WITH {LUMA}, x AS (SELECT video_id, pos, i - 1 AS i, luma[i] AS v FROM fr, range(1, 65) r(i)) SELECT video_id, pos, coalesce(min(CASE WHEN v > 150 THEN i % 8 END), 0) AS x0, coalesce(min(CASE WHEN v > 150 THEN i // 8 END), 0) AS y0, coalesce(max(CASE WHEN v > 150 THEN i % 8 + 1 END), 0) AS x1, coalesce(max(CASE WHEN v > 150 THEN i // 8 + 1 END), 0) AS y1 FROM x GROUP BY ALL")
def f33(spark, sf):
    return pixels.mapped(frames(spark, sf), WIDTH, "x0 long, y0 long, x1 long, y1 long", lambda f, _: dict(zip(("x0", "y0", "x1", "y1"), pixels.content_box(f, 150).T)))


@query("f40_frame_motion")
def f40(spark, sf):
    return pixels.mapped(frames(spark, sf), WIDTH, "dx long, dy long", lambda f, p: dict(zip(("dx", "dy"), pixels.motion(f, p, 2).T)))


def samples(spark, sf) -> DataFrame:
    return t.packets(spark, sf).select("video_id", "pts", "pos", ((F.col("value") - 50) / 50).alias("x"))


@query("f38_k_weighted_steps")
def f38(spark, sf):
    return dsp.weighted_steps(samples(spark, sf), 16)


@query("f39_true_peaks")
def f39(spark, sf):
    return dsp.true_peaks(samples(spark, sf))


# ---- plans ----------------------------------------------------------------------------------------------------
def key_frames(spark, sf) -> DataFrame:
    f = seq.numbered(t.packets(spark, sf)).withColumn("n", F.count("*").over(Window.partitionBy("video_id")))
    return f.where("key OR idx = 0").select("video_id", "idx", "n")


@query("w21_gop_strata")
def w21(spark, sf):
    return plan.strata(key_frames(spark, sf), 12, 3)


@query("w22_scene_strata")
def w22(spark, sf):
    return plan.strata(key_frames(spark, sf), 0, 3, scenes=True)


def scenes(spark, sf) -> DataFrame:
    li = t.table(spark, sf, "lineitem")
    return li.select(F.col("l_partkey").alias("title"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("long").alias("length"), F.col("l_extendedprice").cast("double").alias("si"), F.col("l_discount").cast("double").alias("ti"))


@query("t4_top_scenes")
def t4(spark, sf):
    return plan.take_near(scenes(spark, sf), 300, F.col("si") * F.col("ti"))


@query("m28_balanced_digest")
def m28(spark, sf):
    return plan.balanced_digest(scenes(spark, sf), ["si", "ti"], 6)


@query("m10_smooth_curves")
def m10(spark, sf):
    return plan.smooth_curve(t.probes(spark, sf))


# ---- ladder arithmetic ----------------------------------------------------------------------------------------
@query("m5_nearest_rate", f"WITH {B}, x AS (SELECT title, height, r.rate, bitrate, vmaf, abs(ln(bitrate) - ln(r.rate)) AS d FROM pb, (VALUES (20000.5), (40000.5)) r(rate)) SELECT title, height, CAST(rate AS DOUBLE) AS rate, bitrate, vmaf FROM x QUALIFY row_number() OVER (PARTITION BY title, height, rate ORDER BY round(d, 9), bitrate) = 1")
def m5(spark, sf):
    p = t.probes(spark, sf).withColumn("rate", F.explode(F.array(F.lit(20000.5), F.lit(40000.5))))
    d = F.round(F.abs(F.ln("bitrate") - F.ln("rate")), 9)
    return p.groupBy("title", "height", "rate").agg(F.min_by(F.struct("bitrate", "vmaf"), F.struct(d.alias("d"), "bitrate")).alias("m")).select("title", "height", "rate", "m.bitrate", "m.vmaf")


@query("m12_level_correction", f"WITH {B}, o AS (SELECT title, avg(vmaf) FILTER (bitrate % 3 = 0) - avg(vmaf) FILTER (bitrate % 3 <> 0) AS off FROM pb GROUP BY 1) SELECT title, height, bitrate, round(vmaf + coalesce(off, 0) + 1e-9, 6) AS vmaf FROM pb JOIN o USING (title)")
def m12(spark, sf):
    p, exact = t.probes(spark, sf), F.col("bitrate") % 3 == 0
    o = p.groupBy("title").agg((F.avg(F.when(exact, F.col("vmaf"))) - F.avg(F.when(~exact, F.col("vmaf")))).alias("off"))
    return p.join(o, "title").select("title", "height", "bitrate", r6(F.col("vmaf") + F.coalesce("off", F.lit(0.0)) + 1e-9, "vmaf"))


@query("m16_shot_models", "SELECT l_orderkey, l_linenumber, round(40 + (30 - 40) / 8.0 * (greatest(c, turn) - 22) - 0.05 * (greatest(c, turn) - 22) * (greatest(c, turn) - 30), 6) AS vmaf FROM (SELECT *, l_quantity::DOUBLE AS c, 26 + (30 - 40) / 8.0 / (2 * 0.05) AS turn FROM lineitem)")
def m16(spark, sf):
    v = plan.parabola(F.col("l_quantity").cast("double"), F.lit(22.0), F.lit(30.0), F.lit(40.0), F.lit(30.0), -0.05)
    return t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(v, "vmaf"))


@query("m36_crf_grid", "SELECT o_orderkey, CAST(c AS INT) AS crf FROM (SELECT o_orderkey, 18 + o_orderkey % 5 AS lo FROM orders), LATERAL (SELECT unnest(range(lo, 43, 6)) AS c)")
def m36(spark, sf):
    lo = (F.lit(18) + F.col("o_orderkey") % 5).cast("int")
    return t.table(spark, sf, "orders").select("o_orderkey", F.explode(F.sequence(lo, F.lit(42), F.lit(6))).alias("crf"))


@query("x19_equal_quality_gain", f"WITH {B}, s AS (SELECT *, lag(bitrate) OVER w AS b0, lag(vmaf) OVER w AS v0 FROM pb WINDOW w AS (PARTITION BY title, height ORDER BY bitrate)), z AS (SELECT *, (vmaf - v0) / (ln(bitrate) - ln(b0)) AS sl FROM s WHERE b0 IS NOT NULL) SELECT title, height, bitrate, round(1 - CASE WHEN sl > 0.01 THEN b0 * exp((vmaf - v0) / sl) ELSE b0 END / bitrate, 6) + 0.0 AS gain FROM z")
def x19(spark, sf):
    w = Window.partitionBy("title", "height").orderBy("bitrate")
    s = t.probes(spark, sf).withColumns({"b0": F.lag("bitrate").over(w), "v0": F.lag("vmaf").over(w)}).where("b0 IS NOT NULL")
    dv = F.col("vmaf") - F.col("v0")
    s = s.withColumn("sl", dv / (F.ln("bitrate") - F.ln("b0")))
    other = F.when(F.col("sl") > 0.01, F.col("b0") * F.exp(dv / F.col("sl"))).otherwise(F.col("b0"))
    return s.select("title", "height", "bitrate", (F.round(1 - other / F.col("bitrate"), 6) + 0.0).alias("gain"))


@query("x3_geometry", "SELECT l_orderkey, l_linenumber, CAST(round((240 + l_linenumber * 120) * 1920 / 1080.0 / 2) * 2 AS INT) AS width, greatest(1, CAST(round(2 * l_quantity) AS INT)) AS gop FROM lineitem")
def x3(spark, sf):
    h = F.lit(240) + F.col("l_linenumber") * 120
    return t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fn.even_width(h, F.lit(1920), F.lit(1080)).alias("width"), F.greatest(F.lit(1), F.round(2 * F.col("l_quantity")).cast("int")).alias("gop"))


@query("x32_synthesised_times", f"WITH {P} SELECT video_id, pos, CASE WHEN event_type = 'error' THEN (row_number() OVER (PARTITION BY video_id ORDER BY pts, pos) - 1) * 40000000 ELSE pts END AS pts FROM p")
def x32(spark, sf):
    f = seq.numbered(t.packets(spark, sf))
    return f.select("video_id", "pos", F.coalesce(F.when(F.col("event_type") != "error", F.col("pts")), F.col("idx") * t.FRAME).alias("pts"))


@query("x37_loudness_at_frame", f"WITH {P}, st AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY pts, pos) - 1 AS step, value AS level FROM p), f AS (SELECT video_id, pos, (pts - min(pts) OVER (PARTITION BY video_id)) // 86400000000000 - 1 AS step FROM p) SELECT video_id, pos, level FROM f LEFT JOIN st USING (video_id, step)")
def x37(spark, sf):
    p = t.packets(spark, sf)
    levels = seq.numbered(p).select("video_id", F.col("idx").alias("step"), F.col("value").alias("level"))
    f = p.withColumn("first", F.min("pts").over(Window.partitionBy("video_id"))).select("video_id", "pos", F.expr(f"(pts - first) div {t.DAY} - 1").alias("step"))
    return f.join(levels, ["video_id", "step"], "left").select("video_id", "pos", "level")


@query("f24_buffer", "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) * 2 AS maxrate, CAST(o_totalprice AS BIGINT) * 4 AS buffer FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)")
def f24(spark, sf):
    r = F.floor("o_totalprice").cast("long")
    return t.table(spark, sf, "orders").select("o_orderkey", (r * 2).alias("maxrate"), (r * 4).alias("buffer"))
