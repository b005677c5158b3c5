"""Evapotranspiration by kind of surface [mm a month]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import ColumnLike, col, flag, ln, ratio


def water_stress(moisture: ColumnLike, wilting: ColumnLike, capacity: ColumnLike, strict: bool = False) -> Column:
    s, wp, fc = map(col, (moisture, wilting, capacity))
    return ratio(ln((s - wp) * flag(s > wp) + 1, strict), ln(fc - wp + 1, strict), strict, "ln(capacity - wilting + 1)")


def et_vegetated(etp: ColumnLike, kc: ColumnLike, ks: ColumnLike) -> Column:
    return col(etp) * col(kc) * col(ks)


def pan_coefficient(fetch: ColumnLike, wind: ColumnLike, humidity: ColumnLike, strict: bool = False) -> Column:
    """Class A pan coefficient, which makes the kp input."""
    return 0.482 + 0.024 * ln(col(fetch), strict) - 0.000376 * col(wind) + 0.0045 * col(humidity)


def et_open_water(etp: ColumnLike, kp: ColumnLike, precipitation: ColumnLike, a_o: ColumnLike, strict: bool = False) -> Column:
    """etp / kp; where all is water, at most the rain."""
    e, p = ratio(col(etp), col(kp), strict, "kp"), col(precipitation)
    capped = flag((e > p) & (col(a_o) == 1))
    return p * capped + e * (1 - capped)


def et_bare_soil(etp: ColumnLike, kc_min: ColumnLike, ks: ColumnLike) -> Column:
    return col(etp) * col(kc_min) * col(ks) * flag(col(ks) != 0)


def et_impervious(i_imp: ColumnLike, precipitation: ColumnLike) -> Column:
    return col(i_imp) * flag(col(precipitation) != 0)


def total_et(a_v: ColumnLike, et_v: ColumnLike, a_i: ColumnLike, et_i: ColumnLike, a_o: ColumnLike, et_o: ColumnLike, a_s: ColumnLike, et_s: ColumnLike) -> Column:
    return col(a_v) * col(et_v) + col(a_i) * col(et_i) + col(a_o) * col(et_o) + col(a_s) * col(et_s)
