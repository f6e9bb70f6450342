"""Queries that once failed on larger tables: whole results, and plans and kernels that grow with them."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from framewise.operators import ladder, plan, shares
from framewise.operators.groups import whole_groups
from framewise.plans import registry

PROBES = [(t, h, int(s * math.exp(-0.11 * (crf - 23))) + t, top * (1 - math.exp(-math.exp(-0.11 * (crf - 23)) / 0.4)) - t) for t in (1, 2, 3) for h, top, s in ((1080, 99, 6e6), (720, 94, 3e6), (360, 78, 0.8e6)) for crf in range(18, 39, 5)]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_whole_groups(size):
    d = pd.DataFrame({"g": [1.0, 1, 2, 3, 3, 3, 3, 3, 3, 4, None, None], "x": range(12)})
    got = [pdf.iloc[a:z] for pdf, starts in whole_groups((d.iloc[i : i + size] for i in range(0, 12, size)), ["g"]) for a, z in zip(starts, [*starts[1:], len(pdf)])]
    assert [list(g["x"]) for g in got] == [[0, 1], [2], [3, 4, 5, 6, 7, 8], [9], [10, 11]]


def test_ladders_are_the_operators_one_by_one(spark):
    p = spark.createDataFrame(PROBES, "title long, height int, bitrate long, vmaf double")
    got = ladder.ladders(p, 50)
    assert "Join" not in got._jdf.queryExecution().toString()  # a grid of every title was sent to the driver
    want = ladder.select_rungs(ladder.envelope(ladder.curves(p), 50))
    rows = sorted(got.collect())
    assert len(rows) > 6 and [r[:5] for r in rows] == sorted(map(tuple, want.collect()))
    for a, b in zip(rows, rows[1:]):
        assert a.title != b.title or b.lowered <= a.lowered
    assert all(r.lowered <= r.height for r in rows)


def test_energy_keeps_every_rung(spark):
    sf = "/root/testdata/sf0.001"
    rungs, lowered = (registry.queries()[n](spark, sf) for n in ("m4_rungs", "m7_energy"))
    assert sorted(lowered.drop("lowered").collect()) == sorted(rungs.drop("quality").collect())


def test_lowered_heights():
    """The reference's cases: at the rung's rate 1080 has 85, 720 has 84.5, 540 has 82."""
    heights, has = np.array([[540.0, 720.0, 1080.0]]), np.array([True])
    at = lambda r: np.array([[82.0, 84.5, 85.0]]) - (r[:, None] < 2e6) * 5
    rung = lambda rate, vmaf, h=1080.0: (has, np.array([rate]), np.array([h]), np.array([vmaf]))
    low = lambda rungs, tolerance: [int(h[0]) for h in ladder.lowered(rungs, heights, at, tolerance)]
    assert low([rung(2e6, 85.0)], 0.6) == [720]
    assert low([rung(2e6, 85.0)], 3.0) == [540]
    assert low([rung(2e6, 85.0), rung(1e6, 80.0)], 3.0) == [540, 540]
    assert low([rung(2e6, 95.0)], 1.0) == [1080]  # none within the tolerance: the best
    assert low([rung(2e6, 85.0, 360.0)], 1.0) == [360]  # no curve so low: its own


def test_smooth_curves_in_batches(spark):
    """Against the curve-by-curve form, which took a call of Python for each curve."""
    r = np.random.default_rng(1)
    rows = [(t, h, int(b), float(q)) for t in range(40) for h in (360, 720) for b, q in zip(r.choice(90_000, t % 7 + 1, False) + 1000, r.normal(60, 9, t % 7 + 1))]
    d = spark.createDataFrame([*rows, (None, 360, 5000, 50.0), (None, 360, 7000, 61.0), (99, 360, 5000, None), (99, 360, 6000, 70.0)], "title long, height int, bitrate long, vmaf double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        fit = plan.smooth_curve(d)
        assert "FlatMapGroupsInPandas" not in fit._jdf.queryExecution().toString()
        got = fit.toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) + 4 and got[got.title == 99].fitted.isna().all() and got.fitted.isna().sum() == 2
    m = got.merge(d.toPandas(), on=["title", "height", "bitrate"])
    assert len(m) == len(got)
    for _, g in m[m.title != 99].groupby(["title", "height"], dropna=False):
        z = np.log(g.bitrate.to_numpy(float))
        z = (z - z.mean()) / (z.std() or 1.0)
        x, y = np.vander(z, 4, increasing=True), g.vmaf.to_numpy(float)
        inverse = np.linalg.inv(x.T @ x + np.diag([1e-9, 1e-9, 1.0, 1.0]))
        want = x @ inverse @ x.T @ y
        noise = ((y - want) ** 2).sum() / max(1, len(y) - 2)
        assert np.allclose(g.fitted, want, atol=1e-8) and np.allclose(g.error, np.sqrt(noise * np.einsum("ij,jk,ik->i", x, inverse, x)), atol=1e-6)


def test_class_shares_round_as_the_sql(spark):
    """The SQL's share of each odd number of frames of 640 and 3200, whose seventh digit is a half."""
    rows = [r for n in (640, 3200) for k in range(1, n // 2, 2) for r in ((n * 10_000 + k, "pan", k, 0), (n * 10_000 + k, "shaky", n - k, 1))]
    want = duckdb.connect().execute("SELECT n, k, round(k::HUGEINT / n::HUGEINT, 6) FROM (VALUES (640), (3200)) t(n), range(1, n // 2, 2) r(k)").fetchall()
    got = {(r.video_id // 10_000, r.frames): r.share for r in shares.class_shares(spark.createDataFrame(rows, "video_id long, class string, frames long, start long")).where("class = 'pan'").collect()}
    assert got == {(n, k): share for n, k, share in want}
    assert got[640, 41] == 0.064062
