"""Interception and crop terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import ColumnLike, col, flag, lesser, log10, ratio


def simple_ratio(ndvi: ColumnLike, strict: bool = False) -> Column:
    """(1 + ndvi) / (1 - ndvi)."""
    n = col(ndvi)
    return ratio(1 + n, 1 - n, strict, "1 - ndvi")


def fpar(fpar_min: ColumnLike, fpar_max: ColumnLike, sr: ColumnLike, sr_min: ColumnLike, sr_max: ColumnLike, strict: bool = False) -> Column:
    """Absorbed share of photosynthetically active radiation, at most ``fpar_max``."""
    lo, hi, s, a, b = map(col, (fpar_min, fpar_max, sr, sr_min, sr_max))
    return lesser(ratio((s - a) * (hi - lo), b - a, strict, "sr_max - sr_min") + lo, hi)


def leaf_area_index(fpar_: ColumnLike, fpar_max: ColumnLike, lai_max: ColumnLike, strict: bool = False) -> Column:
    f, hi, most = map(col, (fpar_, fpar_max, lai_max))
    return ratio(most * log10(1 - f, strict), log10(1 - hi, strict), strict, "log10(1 - fpar_max)")


def interception(alpha: ColumnLike, lai: ColumnLike, precipitation: ColumnLike, rainy_days: ColumnLike, a_v: ColumnLike, strict: bool = False) -> Column:
    """Water that vegetation holds back in a month [mm]. 1e-5 is added to the rain of the rate always, also where rain falls."""
    a, leaf, p, days, share = map(col, (alpha, lai, precipitation, rainy_days, a_v))
    full = a * leaf
    p_den = 1 + ratio(p * (1 - F.exp(-0.463 * leaf)), full, strict, "alpha * lai")
    daily = full * (1 - ratio(F.lit(1.0), p_den, strict, "the interception term"))
    return share * p * (1 - F.exp(-ratio(daily * days, p + 1e-5, strict, "precipitation + 1e-5")))


def crop_coef(ndvi: ColumnLike, ndvi_min: ColumnLike, ndvi_max: ColumnLike, kc_min: ColumnLike, kc_max: ColumnLike, strict: bool = False) -> Column:
    n, lo, hi, a, b = map(col, (ndvi, ndvi_min, ndvi_max, kc_min, kc_max))
    return a + (b - a) * ratio(n - lo, hi - lo, strict, "ndvi_max - ndvi_min")


def effective_crop_coef(ndvi: ColumnLike, ndvi_min: ColumnLike, ndvi_max: ColumnLike, kc_min: ColumnLike, kc_max: ColumnLike, strict: bool = False) -> Column:
    """The crop coefficient above 1.1 * ndvi_min, kc_min below it, and 0 at exactly that value."""
    n, limit = col(ndvi), 1.1 * col(ndvi_min)
    return flag(n > limit) * crop_coef(ndvi, ndvi_min, ndvi_max, kc_min, kc_max, strict) + flag(n < limit) * col(kc_min)
