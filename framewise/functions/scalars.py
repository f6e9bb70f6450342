"""Scalar column functions of the media model; all run inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000


def rational(text: Column) -> Column:
    """"30000/1001" or "25" as a double; an empty text or a zero denominator is 0."""
    parts = F.split(F.coalesce(text, F.lit("")), "/")
    num = F.get(parts, F.lit(0)).try_cast("double")
    den = F.when(F.size(parts) > 1, F.get(parts, F.lit(1)).try_cast("double")).otherwise(F.lit(1.0))
    return F.coalesce(F.when(den == 0, 0.0).otherwise(num / den), F.lit(0.0))


def seconds(ns: Column) -> Column:
    """Nanoseconds as seconds rounded to microseconds."""
    return F.round(ns / F.lit(NS), 6)


def levels(color_range: Column) -> Column:
    """Code values of black and white; an unknown range counts as limited."""
    full = color_range.isin("pc", "jpeg")
    return F.struct(F.when(full, 0).otherwise(16).alias("black"), F.when(full, 255).otherwise(235).alias("white"))


def dynamic_range(dovi: Column, transfer: Column, hdr10plus: Column, mastering: Column) -> Column:
    """Dolby Vision before HLG, HDR10+, HDR10, PQ and SDR."""
    pq = transfer == "smpte2084"
    return F.when(dovi, "DolbyVision").when(transfer == "arib-std-b67", "HLG").when(pq & hdr10plus, "HDR10+").when(pq & mastering, "HDR10").when(pq, "PQ").otherwise("SDR")


def bit_depth(coded: Column, pix_fmt: Column) -> Column:
    """The coded depth, else that named by the pixel format, else 8; 0 without a format."""
    named = F.regexp_extract(pix_fmt, r"p(\d{2})(?:le|be)$", 1).try_cast("int")
    return F.coalesce(F.when(coded.try_cast("int") > 0, coded.try_cast("int")), named, F.when(F.coalesce(pix_fmt, F.lit("")) == "", 0).otherwise(8))


def bucket(x: Column, low: float, high: float) -> Column:
    return F.when(x < low, "low").when(x < high, "medium").otherwise("high")


def decibels(energy: Column, floor: float = -120.0) -> Column:
    return F.round(F.when(energy > 0, F.greatest(F.lit(floor), 10 * F.log10(energy))).otherwise(F.lit(floor)), 2)


def loudness(energy: Column, floor: float = -120.0) -> Column:
    """LUFS of a weighted energy, at two decimals."""
    return F.round(F.when(energy > 0, F.greatest(F.lit(floor), F.lit(-0.691) + 10 * F.log10(energy))).otherwise(F.lit(floor)), 2)


# Fixed values of SMPTE ST 2084.
PQ_M1, PQ_M2, PQ_C1, PQ_C2, PQ_C3 = 2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32


def pq_to_nits(e: Column) -> Column:
    p = F.pow(F.least(F.greatest(e, F.lit(0.0)), F.lit(1.0)), F.lit(1 / PQ_M2))
    return 10000 * F.pow(F.greatest(p - PQ_C1, F.lit(0.0)) / (F.lit(PQ_C2) - PQ_C3 * p), F.lit(1 / PQ_M1))


def nits_to_pq(y: Column) -> Column:
    p = F.pow(F.greatest(y, F.lit(0.0)) / 10000, F.lit(PQ_M1))
    return F.pow((F.lit(PQ_C1) + PQ_C2 * p) / (1 + PQ_C3 * p), F.lit(PQ_M2))


def hlg_to_linear(e: Column) -> Column:
    """Inverse OETF of ARIB STD-B67."""
    return F.when(e <= 0.5, e * e / 3).otherwise((F.exp((e - 0.55991073) / 0.17883277) + 0.28466892) / 12)


def psnr_yuv(y: Column, u: Column, v: Column) -> Column:
    """Planes weighted 14:1:1."""
    return (14 * y + u + v) / 16


def mse_to_db(mse: Column, peak: float = 255.0, cap: float = 100.0) -> Column:
    return F.when(mse > 0, F.least(F.lit(cap), 10 * F.log10(F.lit(peak * peak) / mse))).otherwise(F.lit(cap))


def link(vmaf: Column) -> Column:
    v = F.least(F.greatest(vmaf, F.lit(0.5)), F.lit(99.5))
    return F.ln(v / (100 - v))


def unlink(z: Column) -> Column:
    return 100 / (1 + F.exp(-z))


def crf_step(crf: Column, step: float, low: float, high: float) -> Column:
    return F.least(F.greatest(F.round(crf / step) * step, F.lit(low)), F.lit(high))


def even_width(height: Column, source_w: Column, source_h: Column) -> Column:
    return (F.round(height * source_w / source_h / 2) * 2).cast("int")


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution, by Newton steps on the error function."""
    x = 0.0
    for _ in range(60):
        x -= (0.5 * math.erfc(-x / math.sqrt(2)) - p) / (math.exp(-x * x / 2) / math.sqrt(2 * math.pi) + 1e-300)
        x = max(-8.0, min(8.0, x))
    return x


def student_quantile(df: Column, p: float = 0.975) -> Column:
    """Student's t: exact for 1 and 2 degrees of freedom, a series in 1/df above, infinite below 1."""
    z = normal_quantile(p)
    a = 2 * p - 1
    exact1, exact2 = math.tan(math.pi * (p - 0.5)), a * math.sqrt(2 / (1 - a * a))
    z3, z5, z7, z9 = z**3, z**5, z**7, z**9
    d = df.cast("double")
    series = (
        F.lit(z) + F.lit((z3 + z) / 4) / d + F.lit((5 * z5 + 16 * z3 + 3 * z) / 96) / (d * d) + F.lit((3 * z7 + 19 * z5 + 17 * z3 - 15 * z) / 384) / (d * d * d)
        + F.lit((79 * z9 + 776 * z7 + 1482 * z5 - 1920 * z3 - 945 * z) / 92160) / (d * d * d * d)
    )
    return F.when(d < 1, F.lit(float("inf"))).when(d < 2, F.lit(exact1)).when(d < 3, F.lit(exact2)).otherwise(series)


def timecode(ns: Column) -> Column:
    """hh:mm:ss.cc, to the nearest hundredth."""
    cs = F.floor((ns + 5_000_000) / 10_000_000)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, s = F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60
    return F.concat(two(h), F.lit(":"), two(m), F.lit(":"), two(s), F.lit("."), two(cs % 100))


def mean_abs_difference(a: Column, b: Column) -> Column:
    """Of two arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def in_segments(t: Column, segments: Column) -> Column:
    return F.exists(segments, lambda s: (t >= s["start_ns"]) & (t < s["end_ns"]))
