"""Statistics with the definitions of the media reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalars import student_quantile


def nearest_rank(c: str, p: float) -> Column:
    """sorted[ceil(p * n) - 1]."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})")


def summarize(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """mean, min, max, p5, p50, p95; zeros for a group without values."""
    z = lambda x: F.coalesce(x, F.lit(0.0))
    return df.groupBy(*by).agg(z(F.avg(c)).alias("mean"), z(F.min(c)).alias("min"), z(F.max(c)).alias("max"), *[z(nearest_rank(c, p)).alias(n) for p, n in ((0.05, "p5"), (0.5, "p50"), (0.95, "p95"))])


def at_rank(df: DataFrame, by: list[str], c: str, index: Column, name: str) -> DataFrame:
    """The value at an index (from 0, an expression over ``n``) of each group's sorted values; ranked by a window, so no group is held in an array."""
    w = Window.partitionBy(*by).orderBy(c)
    r = df.where(F.col(c).isNotNull()).select(*by, c, (F.row_number().over(w) - 1).alias("_i"), F.count("*").over(Window.partitionBy(*by)).alias("n"))
    return r.where(F.col("_i") == index).select(*by, F.col(c).alias(name))


def ebu_percentile(df: DataFrame, by: list[str], c: str, p: float, name: str) -> DataFrame:
    return at_rank(df, by, c, F.floor((F.col("n") - 1) * p + 0.5), name)


def upper_median(df: DataFrame, by: list[str], c: str, name: str = "median") -> DataFrame:
    return at_rank(df, by, c, F.floor(F.col("n") / 2), name)


def population_sigma(s: Column, sq: Column, n: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), sq / n - (s / n) * (s / n)))


def pooled_estimate(clips: DataFrame, strata: DataFrame, clip_frames: int = 1) -> DataFrame:
    """Stratified mean and half-width at 95 % with one pooled variance within strata.

    clips: video_id, stratum, mean, frames; strata: video_id, stratum, frames, slots.
    """
    s = clips.groupBy("video_id", "stratum").agg((F.sum(F.col("mean") * F.col("frames")) / F.sum("frames")).alias("m"), F.count("*").alias("n"), F.coalesce(F.var_samp("mean"), F.lit(0.0)).alias("v"))
    s = s.join(strata.select("video_id", "stratum", F.col("frames").alias("size"), "slots"), ["video_id", "stratum"])
    total = s.groupBy("video_id").agg(F.sum("size").alias("total"), F.sum(F.when(F.col("n") > 1, F.col("v") * (F.col("n") - 1))).alias("sv"), F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("df"))
    s = s.join(total, "video_id").withColumn("w", F.col("size") / F.col("total"))
    pooled = F.when(F.col("df") > 0, F.col("sv") / F.col("df"))
    part = F.col("w") * F.col("w") * F.greatest(F.lit(0.0), 1 - F.col("n") / F.col("slots")) / F.col("n")
    g = s.groupBy("video_id").agg(F.sum(F.col("w") * F.col("m")).alias("mean"), F.max(pooled).alias("variance"), F.max("df").alias("df"), F.sum(part).alias("k"))
    half = F.when(F.col("k") == 0, 0.0).when(F.col("df") > 0, student_quantile(F.col("df")) * F.sqrt(F.col("variance") * F.col("k"))).otherwise(F.lit(float("inf")))
    return g.select("video_id", "mean", F.coalesce("variance", F.lit(0.0)).alias("variance"), "df", half.alias("half_width"))


def separate_estimate(clips: DataFrame, strata: DataFrame) -> DataFrame:
    """As the pooled one with each stratum's own variance and Satterthwaite's degrees of freedom, floored; strata of one clip leave it infinite."""
    s = clips.groupBy("video_id", "stratum").agg((F.sum(F.col("mean") * F.col("frames")) / F.sum("frames")).alias("m"), F.count("*").alias("n"), F.var_samp("mean").alias("v"))
    s = s.join(strata.select("video_id", "stratum", F.col("frames").alias("size"), "slots"), ["video_id", "stratum"])
    s = s.withColumn("w", F.col("size") / F.sum("size").over(Window.partitionBy("video_id")))
    s = s.withColumn("part", F.when(F.col("n") >= F.col("slots"), 0.0).otherwise(F.col("w") * F.col("w") * (1 - F.col("n") / F.col("slots")) * F.col("v") / F.col("n")))
    g = s.groupBy("video_id").agg(F.sum(F.col("w") * F.col("m")).alias("mean"), F.sum("part").alias("var"), F.sum(F.when(F.col("n") > 1, F.col("part") * F.col("part") / (F.col("n") - 1))).alias("d"), F.count_if((F.col("n") < 2) & (F.col("n") < F.col("slots"))).alias("unknown"))
    df = F.greatest(F.lit(1), F.floor(F.col("var") * F.col("var") / F.nullif(F.col("d"), F.lit(0.0))))
    half = F.when(F.col("unknown") > 0, F.lit(float("inf"))).when(F.col("var") == 0, 0.0).otherwise(student_quantile(df) * F.sqrt("var"))
    return g.select("video_id", "mean", half.alias("half_width"))
