"""Probes and rungs of a ladder: which curve a rung is on, what is probed already, ranges, plans, and what a check decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def curve_for(rungs: DataFrame, curves: DataFrame) -> DataFrame:
    """rungs (title, rung, rate, height) with the height of their curve (curves: title, height, low, high rate): the highest one not above the rung's
    height that was probed at its rate, else the highest not above it, else the lowest of all."""
    c = curves.select("title", F.col("height").alias("h"), "low", "high")
    fits = F.col("h") <= F.col("height")
    rank = F.when(fits & F.col("rate").between(F.col("low"), F.col("high")), F.struct(F.lit(0).alias("k"), (-F.col("h")).alias("o"))).when(fits, F.struct(F.lit(1).alias("k"), (-F.col("h")).alias("o"))).otherwise(F.struct(F.lit(2).alias("k"), F.col("h").alias("o")))
    return rungs.join(c, "title").groupBy("title", "rung", "rate", "height").agg(F.min_by("h", rank).alias("curve"))


def not_probed(jobs: DataFrame, probes: DataFrame, same: float = 0.25) -> DataFrame:
    """The jobs (title, height, crf) with no probe of their height within ``same`` of their CRF. Probes are dealt by cells of that width, so a job meets
    those of three cells only."""
    cell = F.floor(F.col("crf") / same).cast("long")
    near = probes.select("title", "height", F.col("crf").alias("taken"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    j = jobs.withColumn("cell", cell)
    return j.join(near, (j["title"] == near["title"]) & (j["height"] == near["height"]) & (j["cell"] == near["cell"]) & (F.abs(j["crf"] - near["taken"]) < same), "left_anti").drop("cell")


def next_free(jobs: DataFrame, probes: DataFrame, step: float, most: float) -> DataFrame:
    """The jobs moved up by steps of CRF to the first that isn't probed; none beyond ``most``."""
    n = F.round((F.col("taken") - F.col("crf")) / step, 6)
    p = probes.select("title", "height", F.col("crf").alias("taken")).distinct()
    g = jobs.join(p, ["title", "height"], "left").groupBy("title", "height", "crf").agg(F.collect_set(F.when((n >= 0) & (n == F.floor(n)), n.cast("int"))).alias("held"))
    free = F.element_at(F.filter(F.sequence(F.lit(0), F.size("held")), lambda i: ~F.array_contains("held", i)), 1)
    return g.select("title", "height", (F.col("crf") + free * step).alias("crf")).where(F.col("crf") <= most)


def crf_ranges(rungs: DataFrame) -> DataFrame:
    return rungs.groupBy("title", "height").agg(F.min("crf").alias("low"), F.max("crf").alias("high"))


def probe_plan(low: Column, high: Column, spread: float, share: float = 3.0, finest: float = 1.0) -> Column:
    """CRFs evenly over a range widened by the spread on both sides, at most ``share`` spreads apart, each once."""
    lo, hi = F.round((low - spread) / finest) * finest, F.round((high + spread) / finest) * finest
    gaps = F.greatest(F.lit(1), F.ceil((hi - lo) / (share * spread) - 1e-9)).cast("int")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), gaps), lambda g: F.round((lo + (hi - lo) * g / gaps) / finest) * finest))


def level_at(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """rows (title, id, crf) with the level (levels: title, level, high) they fall in: the first whose high end isn't under the CRF, else the last."""
    lv = levels.select("title", "level", "high")
    rank = F.when(F.col("crf") <= F.col("high"), F.struct(F.lit(0).alias("k"), F.col("high").alias("o"))).otherwise(F.struct(F.lit(1).alias("k"), (-F.col("high")).alias("o")))
    return rows.join(lv, "title").groupBy("title", "id", "crf").agg(F.min_by("level", rank).alias("level"))


def probe_pairs(probes: DataFrame) -> DataFrame:
    """Neighbouring probes by CRF of each title and height, with the slopes of quality and of ln(rate) between them."""
    w = Window.partitionBy("title", "height").orderBy("crf")
    nxt = {f"{c}1": F.lead(c).over(w) for c in ("crf", "quality", "rate")}
    p = probes.withColumns(nxt).where(F.col("crf1").isNotNull())
    d = F.col("crf1") - F.col("crf")
    return p.select("title", "height", F.col("crf").alias("low"), F.col("crf1").alias("high"), ((F.col("quality1") - F.col("quality")) / d).alias("quality_slope"), ((F.ln("rate1") - F.ln("rate")) / d).alias("rate_slope"))


def declared_geometry(chunks: DataFrame) -> DataFrame:
    """The size of the highest chunk of each title and rung, the first of equals."""
    return chunks.groupBy("title", "rung").agg(F.min_by(F.struct("width", "height"), F.struct((-F.col("height")).alias("h"), "chunk")).alias("m")).select("title", "rung", "m.width", "m.height")


def encode_costs(probes: DataFrame, rungs: DataFrame) -> DataFrame:
    """Mean CPU seconds of an encode by height, over probes that were made and rungs that were measured."""
    every = probes.where("NOT predicted").select("title", "height", "cpu").unionByName(rungs.select("title", "height", "cpu"))
    return every.where("cpu > 0").groupBy("title", "height").agg(F.avg("cpu").alias("cpu"))


def top_step(before: Column, quality_before: Column, crf: Column, quality: Column, target: float, finest: float = 1.0) -> tuple[Column, Column]:
    """The top rung's next CRF by a secant through two measured ones, and what to do: keep, restore or encode."""
    slope = (quality - quality_before) / F.nullif(crf - before, F.lit(0.0))
    nxt = F.round((crf + (F.lit(target) - quality) / F.nullif(slope, F.lit(0.0))) / finest) * finest
    stuck = slope.isNull() | (slope >= 0) | (nxt == crf)
    action = F.when(stuck, "keep").when(nxt == before, "restore").otherwise("encode")
    return F.when(stuck, crf).otherwise(nxt), action


def keep_per_shot(gain: Column) -> Column:
    """A per-shot version stays only if it measurably gains."""
    return F.coalesce(gain > 0, F.lit(False))


def choose_design(designs: DataFrame, tolerance: float) -> DataFrame:
    """Of each model the design (anchors, error; null if not validated) with the fewest anchors among those within the tolerance, else the one of least
    error, else the one of most anchors; of equals the first."""
    fits = F.coalesce(F.col("error") <= tolerance, F.lit(False))
    rank = F.struct((~fits).alias("a"), F.col("error").isNull().alias("b"), F.when(fits, F.col("anchors")).otherwise(0).alias("c"), F.coalesce("error", -F.col("anchors")).alias("d"), F.col("position").alias("e"))
    return designs.groupBy("model").agg(F.min_by(F.struct("position", "anchors", "error"), rank).alias("m")).select("model", "m.*")


def regressors(titles: DataFrame, anchors: DataFrame, points: list[tuple[int, float]]) -> DataFrame:
    """A column pair (ln of bits per pixel and second, logit of quality) of each anchor point; titles that lack one have no row."""
    q = F.least(F.greatest("quality", F.lit(0.5)), F.lit(99.5))
    a = anchors.where("rate > 0 AND width > 0").select("title", "height", "crf", F.ln(F.col("rate") / (F.col("width") * F.col("height"))).alias("x"), F.ln(q / (100 - q)).alias("z"))
    at = [(F.col("height") == h) & (F.col("crf") == c) for h, c in points]
    cols = [F.max(F.when(w, F.col(v))).alias(f"{v}{i}") for i, w in enumerate(at) for v in ("x", "z")]
    got = a.groupBy("title").agg(*cols)
    return titles.join(got, "title").where(reduce(lambda x, y: x & y, [F.col(f"x{i}").isNotNull() for i in range(len(points))]))


def rendition_gaps(renditions: DataFrame, rungs: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """Renditions (title, rendition, rung, rate) against the rate predicted for their rung."""
    j = renditions.join(rungs.select("title", "rung", F.col("rate").alias("predicted")), ["title", "rung"]).withColumn("gap", F.col("rate") / F.nullif(F.col("predicted"), F.lit(0.0)) - 1)
    return j.select("title", "rendition", "rung", "gap", (F.abs("gap") > tolerance).alias("off"))


def blended(models: DataFrame, parameters: list[str]) -> DataFrame:
    """The mean of several models' parameters by normalised weight."""
    total = F.greatest(F.sum("weight"), F.lit(1e-12))
    return models.groupBy("title").agg(*[(F.sum(F.col("weight") * F.col(p)) / total).alias(p) for p in parameters])
