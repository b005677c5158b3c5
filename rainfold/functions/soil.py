"""Soil water, groundwater and discharge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import ColumnLike, col, flag, ratio


def soil_capacity(theta: ColumnLike, density: ColumnLike, depth: ColumnLike) -> Column:
    """A volumetric content in mm of the root zone: theta * dg * Zr * 10."""
    return col(theta) * col(density) * col(depth) * 10


def _wetness(k_sat: ColumnLike, moisture: ColumnLike, saturation: ColumnLike, strict: bool) -> Column:
    share = ratio(col(moisture), col(saturation), strict, "saturation")
    return col(k_sat) * share * share


def lateral_flow(f: ColumnLike, k_sat: ColumnLike, moisture: ColumnLike, saturation: ColumnLike, strict: bool = False) -> Column:
    return col(f) * _wetness(k_sat, moisture, saturation, strict)


def recharge(f: ColumnLike, k_sat: ColumnLike, moisture: ColumnLike, saturation: ColumnLike, strict: bool = False) -> Column:
    return (1 - col(f)) * _wetness(k_sat, moisture, saturation, strict)


def baseflow(previous: ColumnLike, alpha_gw: ColumnLike, recharge_: ColumnLike, storage: ColumnLike, limit: ColumnLike) -> Column:
    """Recession of the month before and what the recharge adds, while the storage exceeds the limit; else 0."""
    decay = F.exp(-col(alpha_gw))
    return (col(previous) * decay + (1 - decay) * col(recharge_)) * flag(col(storage) > col(limit))


def soil_moisture(previous: ColumnLike, precipitation: ColumnLike, interception: ColumnLike, runoff: ColumnLike, lateral: ColumnLike, recharge_: ColumnLike, et: ColumnLike, a_o: ColumnLike, saturation: ColumnLike) -> Column:
    """The balance, not below 0 and not above saturation; water cells stay saturated."""
    full, land = col(saturation), flag(col(a_o) != 1)
    balance = col(previous) + col(precipitation) - col(interception) - col(runoff) - col(lateral) - col(recharge_) - col(et)
    part = balance * flag(balance > 0) * land + full * (1 - land)
    below = flag(part < full)
    return part * below + full * (1 - below)


def saturated_storage(previous: ColumnLike, recharge_: ColumnLike, baseflow_: ColumnLike) -> Column:
    return col(previous) + col(recharge_) - col(baseflow_)


def cell_discharge_mm(runoff: ColumnLike, lateral: ColumnLike, baseflow_: ColumnLike) -> Column:
    return col(runoff) + col(lateral) + col(baseflow_)


def discharge_m3s(mm: ColumnLike, area: ColumnLike, days: ColumnLike, strict: bool = False) -> Column:
    """A month's depth on an area [m2] as mean flow [m3/s]."""
    return ratio(col(mm) * col(area) * 0.001, col(days) * 86400.0, strict, "days")
