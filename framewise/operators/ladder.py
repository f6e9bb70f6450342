"""Rate-quality curves and bitrate ladders over probes (title, height, bitrate, vmaf, crf)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .groups import whole_groups


def pooled(v: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Monotone fit of each run of v that begins at ``starts``."""
    out: list[float] = []
    for a, z in zip(starts, [*starts[1:], len(v)]):
        begin: list[int] = []
        total: list[float] = []
        ends: list[int] = []
        for i in range(a, z):
            j, t = i, v[i]
            while begin and total[-1] * (i + 1 - j) >= t * (ends[-1] - begin[-1]):
                j, t = begin.pop(), t + total.pop()
                ends.pop()
            begin.append(j)
            total.append(t)
            ends.append(i + 1)
        for j, t, e in zip(begin, total, ends):
            out += [t / (e - j)] * (e - j)
    return np.array(out, float)


def isotonic(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Monotone fit of y over x: neighbours that fall are pooled to their mean, taken from prefix sums. Groups lie sorted in their partitions and
    stream through, many in a batch; linear in the points, and only one group's points are held."""
    p = points.select(*by, x, F.col(y).cast("double").alias(y))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in whole_groups(batches, by):
            yield pdf.assign(fitted=pooled(pdf[y].to_numpy(float), starts))

    ship(points.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema.fields)
    return p.repartition(*by).sortWithinPartitions(*by, x, y).mapInPandas(fit, fields + ", fitted double")


def curves(probes: DataFrame) -> DataFrame:
    """Probes with a positive bitrate, ln(bitrate) and monotone quality, by title and height."""
    p = probes.where("bitrate > 0")
    return isotonic(p, ["title", "height"], "bitrate", "vmaf").withColumn("ln_rate", F.ln("bitrate"))


def quality_at(curve: DataFrame, rates: DataFrame) -> DataFrame:
    """Quality of each curve at rates (title, rate), in a line over ln(rate); none beyond the curve's ends."""
    w = Window.partitionBy("title", "height").orderBy("bitrate")
    s = curve.select("title", "height", F.col("bitrate").alias("b0"), F.col("fitted").alias("q0"), F.lead("bitrate").over(w).alias("b1"), F.lead("fitted").over(w).alias("q1"))
    s = s.withColumns({"b1": F.coalesce("b1", "b0"), "q1": F.coalesce("q1", "q0")})
    last = F.col("b0") == F.col("b1")
    j = s.join(rates, "title").where((F.col("rate") >= F.col("b0")) & ((F.col("rate") < F.col("b1")) | (last & (F.col("rate") == F.col("b0")))))
    t = F.when(last, 0.0).otherwise((F.ln("rate") - F.ln("b0")) / F.nullif(F.ln("b1") - F.ln("b0"), F.lit(0.0)))
    return j.select("title", "height", "rate", (F.col("q0") + F.coalesce(t, F.lit(0.0)) * (F.col("q1") - F.col("q0"))).alias("quality"))


def grid(curve: DataFrame, points: int = 200) -> DataFrame:
    """Rates evenly spaced in the logarithm from the least to the greatest of a title."""
    e = curve.groupBy("title").agg(F.min("ln_rate").alias("lo"), F.max("ln_rate").alias("hi"))
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    return e.select("title", "lo", "hi", i).select("title", "i", F.exp(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1)).alias("rate"))


def envelope(curve: DataFrame, points: int = 200) -> DataFrame:
    """The best height at each rate of the grid; the highest of equals (curves are taken from the highest)."""
    g = grid(curve, points)
    q = quality_at(curve, g.select("title", "rate"))
    best = q.groupBy("title", "rate").agg(F.max_by(F.struct("height", "quality"), F.struct("quality", "height")).alias("m"))
    return best.join(g, ["title", "rate"]).select("title", "i", "rate", F.col("m.height").alias("height"), F.col("m.quality").alias("quality"))


RUNGS = "title long, rung int, rate double, height int, quality double"


def picked(rate: np.ndarray, quality: np.ndarray, height: np.ndarray, n: np.ndarray, step: float = 6.0, least: float = 1.5, most: float = 2.5, target: float = 95.0, min_rate: float = 145_000.0, min_quality: float = 0.0, rungs: int = 8, max_rate: float = 0.0) -> list[tuple[np.ndarray, ...]]:
    """``select_rungs`` on many hulls at once, a row each: n points in order of rate, then rates of infinity and qualities of nan. For each rung in turn:
    whether each title has it, its rate, height and quality."""
    rows, log = np.arange(len(rate)), np.log(rate)

    def near(r: np.ndarray) -> np.ndarray:
        return np.where(r >= 0.999 * rate[:, 0], np.abs(log - np.log(r)[:, None]).argmin(1), -1)

    def first(q: np.ndarray) -> np.ndarray:
        reached = quality >= q[:, None]
        return np.where(reached.any(1), reached.argmax(1), n - 1)

    def reaching(q: np.ndarray) -> np.ndarray:
        i = first(q)
        a, z = (rows, np.maximum(i - 1, 0)), (rows, i)
        line = (log[z] - log[a]) / (quality[z] - quality[a]) * (q - quality[a]) + log[a]
        return np.where((i <= 0) | (quality[z] < q), rate[z], np.exp(np.where(q == quality[z], log[z], line)))

    out = []
    with np.errstate(all="ignore"):
        at = first(np.full(len(rate), target))
        r = rate[rows, at]
        if max_rate:
            at, r = np.where(r > max_rate, near(np.full(len(rate), max_rate)), at), np.minimum(r, max_rate)
        at, top = np.where(n > 0, at, -1), height.max(1)
        while (at >= 0).any() and len(out) < rungs:
            has, q = at >= 0, quality[rows, at]
            top = np.where(has, np.minimum(top, height[rows, at]), top)
            out.append((has, r, top, q))
            r = np.rint(np.minimum(np.maximum(reaching(q - step), r / most), r / least))
            at = np.where(has & (r >= min_rate), near(r), -1)
            at = np.where(quality[rows, at] < min_quality, -1, at)
    return out


def padded(keep: np.ndarray, *values: tuple[np.ndarray, float]) -> list[np.ndarray]:
    """Each row's kept values first, then the given filling."""
    order, n = np.argsort(~keep, axis=1, kind="stable"), keep.sum(1)
    past = np.arange(keep.shape[1]) >= n[:, None]
    return [np.where(past, fill, np.take_along_axis(v, order, 1)) for v, fill in values]


def framed(titles: np.ndarray, rungs: list[tuple[np.ndarray, ...]], names: list[str]) -> pd.DataFrame:
    parts = [pd.DataFrame({"title": titles[has], "rung": i} | dict(zip(names, (v[has] for v in rest)))) for i, (has, *rest) in enumerate(rungs)]
    every = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["title", "rung", *names])
    return every.astype({"rung": "int32"} | {k: "int32" for k in ("height", "lowered") if k in names})


def select_rungs(hull: DataFrame, **limits: float) -> DataFrame:
    """From the cheapest point of the hull that reaches the target (its best point if none does), each next rung takes the least rate whose
    quality is ``step`` lower, read on the hull's line over ln(rate) and kept within the ratios; its height and quality are those of the hull's nearest
    point, with no greater height than the rung above. Sequential by nature, on a hull of a few hundred points a title. limits: those of ``picked``."""
    by = ["title"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in whole_groups(batches, by):
            sizes = np.diff([*starts, len(pdf)])
            at = np.minimum(starts[:, None] + np.arange(sizes.max()), len(pdf) - 1)
            keep = np.arange(sizes.max()) < sizes[:, None]
            rate, quality, height = (pdf[c].to_numpy(float)[at] for c in ("rate", "quality", "height"))
            hulls = padded(keep, (rate, np.inf), (quality, np.nan), (height, 0.0))
            yield framed(pdf["title"].to_numpy()[starts], picked(*hulls, sizes, **limits), ["rate", "height", "quality"])

    ship(hull.sparkSession)
    return hull.select("title", "rate", "quality", "height").repartition(*by).sortWithinPartitions("title", "rate").mapInPandas(run, RUNGS)


def read_at(curve: np.ndarray, rate: np.ndarray, log: np.ndarray, fitted: np.ndarray, of: np.ndarray, r: np.ndarray, log_r: np.ndarray) -> np.ndarray:
    """``quality_at`` of rates r on curves ``of``, both of any shape; -inf beyond a curve's ends. Points lie in order of curve (a number) and rate."""
    key, asked = np.empty(len(rate), complex), np.empty(r.shape, complex)
    key.real, key.imag, asked.real, asked.imag = curve, rate, of, r
    k = np.searchsorted(key, asked, "right") - 1  # complex numbers are in order of both their parts
    held = (k >= 0) & (curve[k] == of)
    after = np.minimum(k + 1, len(rate) - 1)
    last = (after == k) | (curve[after] != curve[k])
    after = np.where(last, k, after)
    with np.errstate(all="ignore"):
        gap = log[after] - log[k]
        t = np.where(gap == 0, 0.0, (log_r - log[k]) / gap)
        q = fitted[k] + t * (fitted[after] - fitted[k])
    return np.where(held & (~last | (r == rate[k])) & ~np.isnan(q), q, -np.inf)


def lowered(rungs: list[tuple[np.ndarray, ...]], heights: np.ndarray, quality: Callable[[np.ndarray], np.ndarray], tolerance: float) -> list[np.ndarray]:
    """The height of each rung in turn: the lowest whose quality at the rung's rate lies within the tolerance of the rung's, among those no greater than the
    rung's and the one above's; if none does, the best of these; if none is known there, the rung's own, or the one above's if that is less.
    heights: a row a title, nan past its curves; quality(rates): -inf where unknown."""
    out, above = [], np.full(len(heights), np.inf)
    for has, rate, height, wanted in rungs:
        most = np.minimum(height, above)
        q = np.where(heights <= most[:, None], quality(rate), -np.inf)
        known, fits = q > -np.inf, (q >= wanted[:, None] - tolerance) & (q > -np.inf)
        best = np.where(known & (q == q.max(1)[:, None]), heights, -np.inf).max(1)
        h = np.where(fits.any(1), np.where(fits, heights, np.inf).min(1), np.where(known.any(1), best, most))
        above = np.where(has, h, above)
        out.append(h)
    return out


def ladders(probes: DataFrame, points: int = 200, tolerance: float = 1.0, **limits: float) -> DataFrame:
    """Probes to rungs, with the height to which each is lowered for energy: ``select_rungs`` of the ``envelope`` of ``curves``, and ``lowered``, in one pass
    over titles that lie sorted in their partitions. No grid is joined or shuffled: its rates come with a title's first probe."""
    p = probes.where("bitrate > 0").select("title", "height", "bitrate", F.col("vmaf").cast("double").alias("vmaf"), F.ln("bitrate").alias("ln_rate")).repartition("title")
    w = Window.partitionBy("title")
    p = p.withColumn("first", F.row_number().over(w.orderBy("height", "bitrate", "vmaf")) == 1).withColumns({"lo": F.min("ln_rate").over(w), "hi": F.max("ln_rate").over(w)})
    rates = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.exp(F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points - 1)))
    p = p.select("title", "height", "bitrate", "vmaf", "ln_rate", F.when(F.col("first"), rates).alias("rates"))
    p = p.withColumn("logs", F.transform("rates", F.ln)).sortWithinPartitions("title", "height", "bitrate", "vmaf")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in whole_groups(batches, ["title"]):
            rate, log, height = (pdf[c].to_numpy(float) for c in ("bitrate", "ln_rate", "height"))
            begins = np.union1d(starts, 1 + np.flatnonzero(np.diff(height)))
            fitted = pooled(pdf["vmaf"].to_numpy(float), begins)
            curve = np.repeat(np.arange(len(begins)), np.diff([*begins, len(pdf)]))
            own = np.searchsorted(begins, starts)  # a title's first curve
            of = np.repeat(np.arange(len(starts)), np.diff([*own, len(begins)]))
            grid, logs = (np.stack(pdf[c].to_numpy()[starts]) for c in ("rates", "logs"))
            h = height[begins]

            q = read_at(curve, rate, log, fitted, np.broadcast_to(np.arange(len(begins))[:, None], (len(begins), points)), grid[of], logs[of])
            quality = np.maximum.reduceat(q, own)
            best = np.maximum.reduceat(np.where(q == quality[of], h[:, None], -np.inf), own)
            known = quality > -np.inf
            rungs = picked(*padded(known, (grid, np.inf), (quality, np.nan), (best, 0.0)), known.sum(1), **limits)

            sizes = np.diff([*own, len(begins)])
            each = own[:, None] + np.arange(sizes.max())
            past = np.arange(sizes.max()) >= sizes[:, None]
            each = np.where(past, own[:, None], each)

            def at(r: np.ndarray) -> np.ndarray:
                r = np.broadcast_to(r[:, None], each.shape)
                return read_at(curve, rate, log, fitted, each, r, np.log(r))

            low = lowered(rungs, np.where(past, np.nan, h[each]), at, tolerance)
            yield framed(pdf["title"].to_numpy()[starts], [(*r, x) for r, x in zip(rungs, low)], ["rate", "height", "quality", "lowered"])

    ship(probes.sparkSession)
    return p.mapInPandas(run, RUNGS + ", lowered int")


def rate_gap(a: DataFrame, b: DataFrame, step: float = 0.5) -> DataFrame:
    """How much more rate ladder a needs than b at equal quality: the geometric mean over a grid of qualities from the top of both."""
    def segs(d: DataFrame, p: str) -> DataFrame:
        w = Window.partitionBy("title").orderBy("quality", "rate")
        r = d.select("title", F.col("quality").alias("q0"), F.ln("rate").alias("r0"), F.lead("quality").over(w).alias("q1"), F.lead(F.ln("rate")).over(w).alias("r1"))
        return r.where("q1 > q0").select("title", F.col("q0").alias(p + "q0"), F.col("q1").alias(p + "q1"), F.col("r0").alias(p + "r0"), F.col("r1").alias(p + "r1"))

    ends = a.groupBy("title").agg(F.min("quality").alias("al"), F.max("quality").alias("ah")).join(b.groupBy("title").agg(F.min("quality").alias("bl"), F.max("quality").alias("bh")), "title")
    lo, hi = F.greatest("al", "bl"), F.least("ah", "bh")
    g = ends.where(hi > lo).select("title", F.explode(F.sequence(F.lit(0), F.floor((hi - lo) / step))).alias("i"), hi.alias("hi")).select("title", (F.col("hi") - F.col("i") * step).alias("q"))
    at = lambda p: F.col(p + "r0") + (F.col("q") - F.col(p + "q0")) * (F.col(p + "r1") - F.col(p + "r0")) / (F.col(p + "q1") - F.col(p + "q0"))
    j = g.join(segs(a, "a"), "title").where("q > aq0 AND q <= aq1").join(segs(b, "b"), "title").where("q > bq0 AND q <= bq1")
    return j.groupBy("title").agg((F.exp(F.avg(at("a") - at("b"))) - 1).alias("mean_gap"), (F.exp(F.max(at("a") - at("b"))) - 1).alias("worst_gap"), F.count("*").alias("points"))


def allocate(menu: DataFrame, price: float) -> DataFrame:
    """Equal-slope choice: each unit takes the entry of greatest quality - price * rate; the first of equals by position."""
    value = F.round(F.col("quality") - price * F.col("rate"), 9)
    w = Window.partitionBy("title", "unit").orderBy(F.desc(value), "position")
    return menu.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def allocation_price(menu: DataFrame, target: float, steps: int = 60) -> DataFrame:
    """The greatest price by title at which the chosen entries still average the target quality: bisection in the logarithm, on each title's small menu."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        units = [(u["quality"].to_numpy(), u["rate"].to_numpy()) for _, u in pdf.sort_values("position").groupby("unit")]
        mean = lambda p: float(np.mean([q[np.argmax(q - p * r)] for q, r in units]))
        lo, hi = -12.0, 6.0
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if mean(10**mid) >= target else (lo, mid)
        return pd.DataFrame({"title": [int(pdf["title"].iloc[0])], "price": [10**lo], "quality": [mean(10**lo)]})

    ship(menu.sparkSession)
    return menu.groupBy("title").applyInPandas(one, "title long, price double, quality double")


def ridge(x: np.ndarray, y: np.ndarray, penalty: float, weight: np.ndarray | None = None) -> np.ndarray:
    """Weighted ridge with an unpenalised first column."""
    w = np.ones(len(y)) if weight is None else weight
    a = (x * w[:, None]).T @ x
    d = np.full(x.shape[1], penalty)
    d[0] = 0
    return np.linalg.solve(a + np.diag(d) + 1e-12 * np.eye(len(d)), (x * w[:, None]).T @ y)


def train_models(rows: DataFrame, features: list[str], target: str, by: list[str], penalty: float = 0.3) -> DataFrame:
    """One ridge of standardised features for each group (a grid point's titles). Sums of products make the normal equations, so no group's rows
    meet in one place; a group's few sums are solved in one row."""
    x = [F.col(f).cast("double") for f in features]
    y, n = F.col(target).cast("double"), len(features)
    good = reduce(lambda p, q: p & q, [c.isNotNull() for c in [*x, y]])
    sums = rows.where(good).groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(y).alias("y"), F.array(*[F.sum(c) for c in x]).alias("s"), F.array(*[F.sum(c * y) for c in x]).alias("sy"),
        F.array(*[F.sum(x[i] * x[j]) for i in range(n) for j in range(n)]).alias("ss"),
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                mean, m = np.array(r.s) / r.n, r.y / r.n
                c = np.array(r.ss).reshape(n, n) - r.n * np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(c), 0) / r.n)
                sd[sd <= 1e-9 * np.maximum(1, np.abs(mean))] = 1
                w = np.linalg.solve(c / np.outer(sd, sd) + (penalty + 1e-12) * np.eye(n), (np.array(r.sy) - r.n * mean * m) / sd) / sd
                out.append({**{b: getattr(r, b) for b in by}, "n": r.n, "weights": w.tolist(), "bias": float(m - w @ mean)})
            yield pd.DataFrame(out, columns=[*by, "n", "weights", "bias"])

    ship(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return sums.mapInPandas(solve, ", ".join(f"{b} {kinds[b]}" for b in by) + ", n long, weights array<double>, bias double")


def predict(rows: DataFrame, models: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """rows with bias + weights . features of their group's model; models are one row a group and are joined, not collected."""
    m = models.select(*by, "weights", "bias")
    dot = F.aggregate(F.zip_with(F.col("weights"), F.array(*[F.col(f).cast("double") for f in features]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.join(m, by).withColumn("predicted", F.col("bias") + dot).drop("weights", "bias")


