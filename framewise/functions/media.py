"""Scalar columns about streams, layouts, targets and metrics: signalling, parsing, colour differences."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import nits_to_pq

# Loudness targets (integrated LUFS, tolerance, greatest true peak).
TARGETS = {"ebu": (-23.0, 0.5, -1.0), "ebu-live": (-23.0, 1.0, -1.0), "atsc": (-24.0, 2.0, -2.0), "streaming": (-16.0, 1.0, -1.0), "streaming-14": (-14.0, 1.0, -1.0)}
CUSTOM = (1.0, -1.0)
# Label, unit, whether lower is better, decimals of metric series.
SERIES = {
    "xpsnr_y": ("XPSNR Y", "dB", False, 2), "xpsnr_u": ("XPSNR U", "dB", False, 2), "xpsnr_v": ("XPSNR V", "dB", False, 2), "cambi": ("CAMBI (banding)", "", True, 2),
    "psnr_y": ("PSNR Y", "dB", False, 2), "psnr_cb": ("PSNR Cb", "dB", False, 2), "psnr_cr": ("PSNR Cr", "dB", False, 2), "ssim": ("SSIM", "", False, 4), "ms_ssim": ("MS-SSIM", "", False, 4),
    "ciede2000": ("CIEDE2000", "dB", False, 2), "delta_e_itp": ("ΔE ITP", "", True, 2),
}
SURROUND = 1.41
#: ITU-R BT.2100: RGB to LMS, and PQ-coded LMS to I, Ct, Cp, in 4096ths.
LMS = ((1688, 2146, 262), (683, 2951, 462), (99, 309, 3688))
ICTCP = ((2048, 2048, 0), (6610, -13613, 7003), (17933, -17390, -543))


def is_hdr(transfer: Column) -> Column:
    return F.coalesce(transfer.isin("smpte2084", "arib-std-b67"), F.lit(False))


def full_range(colour_range: Column) -> Column:
    return F.coalesce(colour_range.isin("pc", "jpeg"), F.lit(False))


def measurable_hdr(transfer: Column, dolby_profile: Column, compatibility: Column) -> Column:
    """HDR whose base layer shows the picture: no Dolby Vision, or one that is compatible."""
    return is_hdr(transfer) & (dolby_profile.isNull() | (F.coalesce(compatibility, F.lit(0)) != 0))


def loudness_target(text: Column) -> Column:
    """(name, integrated, tolerance, max_true_peak) of a preset's name or a number of LUFS from -70 to 0; the first preset for no text, null for others."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    number = F.trim(F.regexp_replace(t, "lufs$", "")).try_cast("double")
    make = lambda name, x, tol, peak: F.struct(F.lit(name).alias("name"), x.alias("integrated"), F.lit(tol).alias("tolerance"), F.lit(peak).alias("max_true_peak"))
    first = next(iter(TARGETS))
    out = F.when(t == "", make(first, F.lit(TARGETS[first][0]), *TARGETS[first][1:]))
    for name, (x, tol, peak) in TARGETS.items():
        out = out.when(t == name, make(name, F.lit(x), tol, peak))
    return out.when((number >= -70) & (number <= 0), make("custom", number, *CUSTOM))


def sample_budget(text: Column) -> Column:
    """(share, per_scene) of "5%" or "2/scene"; null for others."""
    t = F.lower(F.trim(text))
    share = F.regexp_extract(t, r"^\s*([0-9.]+)\s*%$", 1).try_cast("double") / 100
    scene = F.regexp_extract(t, r"^\s*([0-9]+)\s*/(?:scene|shot)$", 1).try_cast("int")
    made = lambda s, n: F.struct(s.cast("double").alias("share"), n.cast("int").alias("per_scene"))
    return F.when((share > 0) & (share <= 1), made(share, F.lit(0))).when(scene >= 1, made(F.lit(0.0), scene))


def known_names(names: Column, known: list[str], implicit: str = "") -> Column:
    """The known ones of an array of names, trimmed and in lower case, each once and in the order of known; null if one isn't known."""
    n = F.filter(F.transform(names, lambda x: F.lower(F.trim(x))), lambda x: ~x.isin("", implicit))
    every = F.array(*map(F.lit, known))
    return F.when(F.size(F.array_except(n, every)) == 0, F.filter(every, lambda x: F.array_contains(n, x)))


def series_info(name: Column) -> Column:
    """(label, unit, lower_is_better, decimals) of a metric series; the name itself for others."""
    make = lambda a, b, c, d: F.struct(a.alias("label"), F.lit(b).alias("unit"), F.lit(c).alias("lower_is_better"), F.lit(d).alias("decimals"))
    out = F.when(name.isNull(), make(name, "", False, 2))
    for k, (a, b, c, d) in SERIES.items():
        out = out.when(name == k, make(F.lit(a), b, c, d))
    return out.otherwise(make(name, "", False, 2))


def worst(name: Column, p5: Column, p95: Column) -> Column:
    return F.when(series_info(name)["lower_is_better"], p95).otherwise(p5)


def channel_weights(layout: Column) -> Column:
    """Loudness weights of a layout such as FL+FR+FC+LFE+BL+BR: low frequencies 0, surrounds 1.41 (the back ones only without side ones)."""
    c = F.transform(F.split(layout, r"\+"), F.trim)
    sides = F.arrays_overlap(c, F.array(F.lit("SL"), F.lit("SR")))
    return F.transform(c, lambda x: F.when(x.isin("LFE", "LFE2"), 0.0).when(x.isin("SL", "SR") | (x.isin("BL", "BR") & ~sides), SURROUND).otherwise(1.0))


def stereo_pairs(layout: Column) -> Column:
    """Positions (left, right) of the stereo pairs a layout has."""
    c = F.transform(F.split(layout, r"\+"), F.trim)
    at = lambda x: F.array_position(c, x).cast("int") - 1
    pairs = F.array(*[F.struct(at(x).alias("left"), at(y).alias("right")) for x, y in (("FL", "FR"), ("DL", "DR"), ("SL", "SR"), ("BL", "BR"))])
    return F.filter(pairs, lambda p: (p["left"] >= 0) & (p["right"] >= 0))


def itp(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """I, T, P of linear BT.2020 light in nits."""
    lms = [nits_to_pq((x * r + y * g + z * b) / 4096) for x, y, z in LMS]
    i, t, p = ((x * lms[0] + y * lms[1] + z * lms[2]) / 4096 for x, y, z in ICTCP)
    return i, t / 2, p


def delta_e_itp(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """720 times the distance in I, T, P of two colours (r, g, b in nits)."""
    return 720 * F.sqrt(sum(((x - y) * (x - y) for x, y in zip(itp(*a), itp(*b))), F.lit(0.0)))


def xpsnr_raw(db: Column, width: Column, height: Column, bits: Column, luma: bool = True) -> Column:
    """The root of the weighted squared error of a plane of which the XPSNR is given; chroma planes are half as wide and high."""
    half = lambda x: x if luma else F.floor((x + 1) / 2)
    peak = F.pow(F.lit(2.0), bits) - 1
    return F.sqrt(half(width) * half(height) * peak * peak / F.pow(F.lit(10.0), db / 10))


def camera_rates(tx: Column, ty: Column, zr: Column, zi: Column, dt: Column, width: Column) -> dict[str, Column]:
    """Pan and tilt in % of the width a second, zoom in % and roll in degrees a second, of a motion t + (1 + z) x."""
    return {"pan": -tx / width * 100 / dt, "tilt": ty / width * 100 / dt, "zoom": F.ln(F.hypot(1 + zr, zi)) * 100 / dt, "roll": -F.atan2(zi, 1 + zr) * (180 / math.pi) / dt}


def steady_rate(nominal: Column, average: Column, tolerance: float = 0.02) -> Column:
    """The nominal frame rate, unless the average is farther off than the tolerance."""
    return F.when((nominal > 0) & (F.abs(average / nominal - 1) <= tolerance), nominal).otherwise(average)
