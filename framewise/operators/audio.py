"""Loudness gating and channel defects over 100 ms steps (video_id, pos, pts, energy)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import loudness
from ..functions.stats import ebu_percentile
from .seq import in_order


def windowed(steps: DataFrame, n: int) -> DataFrame:
    """Loudness of the last n steps; a window cut short at the start is divided by its whole length."""
    w = in_order("pos").rowsBetween(-(n - 1), 0)
    mean = F.sum("energy").over(w) / n
    return steps.select("video_id", "pos", "pts", (F.row_number().over(in_order("pos")) - 1).alias("step"), mean.alias("energy"), loudness(mean).alias("level"))


def max_level(steps: DataFrame, n: int) -> DataFrame:
    """Loudest complete window."""
    return windowed(steps, n).where(F.col("step") >= n - 1).groupBy("video_id").agg(F.max("level").alias("max_level"))


def gated(steps: DataFrame, n: int = 4) -> DataFrame:
    """Integrated loudness: complete windows over -70, then over the mean of these less 10."""
    raw = F.lit(-0.691) + 10 * F.log10(F.col("energy"))
    b = windowed(steps, n).where((F.col("step") >= n - 1) & (F.col("energy") > 0)).withColumn("l", raw).where("l >= -70")
    gate = b.groupBy("video_id").agg((F.lit(-0.691) + 10 * F.log10(F.avg("energy")) - 10).alias("gate"))
    return b.join(gate, "video_id").where("l >= gate").groupBy("video_id").agg(loudness(F.avg("energy")).alias("integrated"), F.count("*").alias("blocks"))


def loudness_range(steps: DataFrame, n: int = 30) -> DataFrame:
    """p95 - p10 of short-term loudness over -70 and over the mean less 20."""
    raw = F.lit(-0.691) + 10 * F.log10(F.col("energy"))
    b = windowed(steps, n).where((F.col("step") >= n - 1) & (F.col("energy") > 0)).withColumn("l", raw).where("l >= -70")
    gate = b.groupBy("video_id").agg((F.lit(-0.691) + 10 * F.log10(F.avg("energy")) - 20).alias("gate"))
    b = b.join(gate, "video_id").where("l >= gate")
    low, high = ebu_percentile(b, ["video_id"], "l", 0.10, "p10"), ebu_percentile(b, ["video_id"], "l", 0.95, "p95")
    return low.join(high, "video_id").select("video_id", F.round(F.col("p95") - F.col("p10"), 2).alias("range"))


def pair_correlation(steps: DataFrame, left: str, right: str) -> DataFrame:
    """Uncentred correlation of two channels, whether they are identical or inverted, and the mean difference."""
    l, r = F.col(left), F.col(right)
    g = steps.groupBy("video_id").agg(F.sum(l * r).alias("lr"), F.sum(l * l).alias("ll"), F.sum(r * r).alias("rr"), F.bool_and(l == r).alias("identical"), F.bool_and(l == -r).alias("inverted"), F.avg(F.abs(l - r)).alias("difference"))
    return g.select("video_id", F.coalesce(F.col("lr") / F.nullif(F.sqrt(F.col("ll") * F.col("rr")), F.lit(0.0)), F.lit(0.0)).alias("correlation"), "identical", "inverted", "difference")


def phase(steps: DataFrame, left: str, right: str, n: int = 4, silence: float = 1e-9) -> DataFrame:
    """The correlation over the last n steps; 0 where they are silent."""
    w = in_order("pos").rowsBetween(-(n - 1), 0)
    lr, ll, rr = (F.sum(F.col(a) * F.col(b)).over(w) for a, b in ((left, right), (left, left), (right, right)))
    return steps.select("video_id", "pos", F.when((ll > silence) & (rr > silence), lr / F.sqrt(ll * rr)).otherwise(0.0).alias("phase"))


def merged_runs(runs: DataFrame, gap: int, most: int = 100) -> DataFrame:
    """Runs nearer than ``gap`` made one; the first ``most`` of each video are reported."""
    w = Window.partitionBy("video_id").orderBy("start")
    new = F.when(F.col("start") - F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) <= gap, 0).otherwise(1)
    g = runs.withColumn("_g", new).withColumn("run", F.sum("_g").over(w)).groupBy("video_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    return g.where(F.col("run") <= most)
