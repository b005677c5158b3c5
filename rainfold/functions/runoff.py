"""Surface runoff terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import ColumnLike, col, flag, ratio


def rain_per_rainy_day(precipitation: ColumnLike, rainy_days: ColumnLike, strict: bool = False) -> Column:
    return ratio(col(precipitation), col(rainy_days), strict, "rainy_days")


def soil_moisture_coef(moisture: ColumnLike, density: ColumnLike, depth: ColumnLike, saturation: ColumnLike, beta: ColumnLike, strict: bool = False) -> Column:
    """((s / (dg * Zr * 10)) / tsat) ** beta, with the saturation content in mm, unclipped."""
    share = ratio(col(moisture), col(density) * col(depth) * 10, strict, "density * depth")
    return F.pow(ratio(share, col(saturation), strict, "saturation"), col(beta))


def permeable_runoff_coef(wilting: ColumnLike, density: ColumnLike, depth: ColumnLike, slope: ColumnLike, manning: ColumnLike, w_1: ColumnLike, w_2: ColumnLike, w_3: ColumnLike, strict: bool = False) -> Column:
    theta = ratio(col(wilting), col(density) * col(depth) * 10, strict, "density * depth")
    land = ratio(F.lit(0.02), col(manning), strict, "manning")
    return col(w_1) * land + col(w_2) * ratio(theta, 1 - theta, strict, "1 - theta") + col(w_3) * ratio(col(slope), 10 + col(slope), strict, "10 + slope")


def impervious_share(a_o: ColumnLike, a_i: ColumnLike) -> Column:
    return col(a_o) + col(a_i)


def impervious_runoff_coef(share: ColumnLike) -> Column:
    return 0.09 * F.exp(2.4 * col(share))


def weighted_runoff_coef(share: ColumnLike, permeable: ColumnLike, impervious: ColumnLike) -> Column:
    return (1 - col(share)) * col(permeable) + col(share) * col(impervious)


def actual_runoff_coef(weighted: ColumnLike, rain_per_day: ColumnLike, rcd: ColumnLike, strict: bool = False) -> Column:
    c, p, r = map(col, (weighted, rain_per_day, rcd))
    return ratio(c * p, c * p - r * c + r, strict, "the rainfall term")


def surface_runoff(runoff_coef: ColumnLike, moisture_coef: ColumnLike, precipitation: ColumnLike, interception: ColumnLike, a_o: ColumnLike, et_water: ColumnLike, moisture: ColumnLike, saturation: ColumnLike) -> Column:
    """Runoff of a month [mm].

    Land that isn't saturated: coefficients times net rain; saturated (exactly at the
    saturation content): the net rain. Water: rain less evaporation, not below 0, and
    twice that if its cell isn't saturated, as when a cell turns to water.
    """
    p, net = col(precipitation), col(precipitation) - col(interception)
    water, full = flag(col(a_o) == 1), flag(col(moisture) == col(saturation))
    spare = p - col(et_water)
    part = col(runoff_coef) * col(moisture_coef) * net * (1 - water) + spare * flag(spare > 0) * water
    return part * (1 - full) + net * full * (1 - water) + part * water
