"""The monthly water balance: state-free columns, then a fold over the months of each cell."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import evapo, runoff, soil, vegetation
from ..functions.guards import col, flag, ln, ratio
from ..params import ParameterColumns, Parameters
from .network import BITS, block_of
from .small import small


def with_soil(cells: DataFrame, soil_attr: DataFrame) -> DataFrame:
    """Adds the soil attributes of each cell and the contents in mm: tsat, wp, fc. Class tables are small; a class without a row gives NULL."""
    joined = cells.join(small(soil_attr), "soil", "left")
    return joined.withColumns({name: soil.soil_capacity(theta, "bulk_density", "rootzone_depth") for name, theta in (("tsat", "t_sat"), ("wp", "t_wp"), ("fc", "t_fcap"))})


def with_landuse(forcing: DataFrame, landuse_attr: DataFrame) -> DataFrame:
    """Adds the land-use attributes of each cell and month."""
    return forcing.join(small(landuse_attr), "landuse", "left")


def state_free(cell_months: DataFrame, p: Parameters | ParameterColumns) -> DataFrame:
    """Adds all monthly terms that don't depend on the state: lai, itp, kc, et_o, et_i, runoff_coef.

    ``cell_months`` has the columns of forcing, cells (with slope), both attribute tables, with_soil and rainy days (days);
    with ``ParameterColumns`` also the parameters, as after ``sweep``.
    """
    sr = lambda c: vegetation.simple_ratio(c)
    rows = cell_months.withColumn("fpar", vegetation.fpar(p.fpar_min, p.fpar_max, sr("ndvi"), sr("ndvi_min"), sr("ndvi_max")))
    rows = rows.withColumn("lai", vegetation.leaf_area_index("fpar", p.fpar_max, p.lai_max))
    share = runoff.impervious_share("a_o", "a_i")
    permeable = runoff.permeable_runoff_coef("wp", "bulk_density", "rootzone_depth", "slope", "manning", p.w_1, p.w_2, p.w_3)
    weighted = runoff.weighted_runoff_coef(share, permeable, runoff.impervious_runoff_coef(share))
    return rows.withColumns(
        {
            "itp": vegetation.interception(p.alpha, "lai", "precipitation", "days", "a_v"),
            "kc": vegetation.effective_crop_coef("ndvi", "ndvi_min", "ndvi_max", "kc_min", "kc_max"),
            "et_o": evapo.et_open_water("etp", "kp", "precipitation", "a_o"),
            "et_i": evapo.et_impervious(p.i_imp, "precipitation"),
            "weighted_coef": weighted,
        }
    ).withColumn("runoff_coef", runoff.actual_runoff_coef("weighted_coef", runoff.rain_per_rainy_day("precipitation", "days"), p.rcd))


TERMS = ("itp", "eta", "srn", "lfw", "rec", "bfw", "smc", "sat", "rnf")


def fold_months(m: dict[str, np.ndarray], c: dict[str, np.ndarray], smooth: bool) -> dict[str, np.ndarray]:
    """The terms of all months (cells x months) from monthly terms ``m`` and those of each cell ``c``; NaN is unknown and makes the rest of its cell unknown."""
    n, months = m["net"].shape
    out = {k: np.full((n, months), np.nan) for k in (*TERMS, *(["flow"] if smooth else []))}
    smc, sat, bfw, flow = c["smc"], c["sat"], c["bfw"], np.zeros(n)
    decay = np.exp(-c["alpha_gw"])
    known = _known
    for t in range(months):
        land, net = m["land"][:, t], m["net"][:, t]
        full = known(smc == c["tsat"], smc, c["tsat"])
        ks = np.log(np.maximum(smc - c["wp"], 0) + 1) / c["dry"]
        eta = m["e0"][:, t] + m["e1"][:, t] * ks
        wet = m["r"][:, t] * (smc * c["inv"]) ** c["beta"] * land + m["spare"][:, t] * (1 - land)
        srn = wet * (1 - full) + net * full * land + wet * (1 - land)
        share = smc / c["tsat"]
        drained = c["k_sat"] * share * share
        lfw, rec = c["f"] * drained, (1 - c["f"]) * drained
        bfw = (bfw * decay + (1 - decay) * rec) * known(sat > c["bfw_lim"], sat)
        smc = np.minimum(np.maximum(smc + net - srn - drained - eta, 0) * land + c["tsat"] * (1 - land), c["tsat"])
        sat = sat + rec - bfw
        rnf = srn + lfw + bfw
        for k, v in (("itp", m["itp"][:, t]), ("eta", eta), ("srn", srn), ("lfw", lfw), ("rec", rec), ("bfw", bfw), ("smc", smc), ("sat", sat), ("rnf", rnf)):
            out[k][:, t] = v
        if smooth:
            out["flow"][:, t] = flow = c["x"] * flow + (1 - c["x"]) * rnf * m["to_flow"][:, t]
    return out


#: A block's cells are folded in so many groups: 1024 cells at once.
PARTS = 4


def _by_months(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each number of months, the cells that have it: their ids and the rows of their months (cells x months) in order of step."""
    cell, step = table.column("cell_id").to_numpy(), table.column("step").to_numpy()
    order = np.lexsort((step, cell))
    ids, first, sizes = np.unique(cell[order], return_index=True, return_counts=True)
    for n in np.unique(sizes):
        own = sizes == n
        yield ids[own], order[first[own][:, None] + np.arange(n)]


def water_balance(rows: DataFrame, p: Parameters | ParameterColumns, state: DataFrame | None = None, by: tuple[str, ...] = (), smooth: bool = False, hand_on: tuple[str, ...] = (), packed: bool = False) -> DataFrame:
    """Folds the months of each cell in order of ``step``: *by, cell_id, step, itp, eta, srn, lfw, rec, bfw, smc, sat, rnf.

    ``rows`` come from ``state_free``. The state starts from the parameters, or from ``state``
    (*by, cell_id, smc, sat, bfw), the end of an earlier run. In a month every term reads the state at the end of
    the month before. A NULL term makes the rest of its cell NULL. With ``smooth`` also flow, the discharge
    [m3/s] after recession from 0 (``rows`` then have days_in_month). With ``ParameterColumns`` each row has its parameters, and
    ``by`` names the parameter set. With ``packed`` one row a cell: *by, cell_id, *hand_on (columns that a cell's months share), and step and the terms as arrays.

    Cells are folded by blocks, all cells of a group together, month by month. Every cell has as many rows as there are months, so no group
    is larger than others. Rows of a basin stored by ``store_basin`` are grouped where they lie, without a shuffle, whatever the number of parameter sets.
    """
    if "block" not in rows.columns:
        rows = rows.withColumn("block", F.shiftleft(block_of("cell_id"), BITS))
    land = flag(F.col("a_o") != 1)
    month = {
        "itp": F.col("itp"),
        "net": F.col("precipitation") - F.col("itp"),
        "e0": F.col("a_i") * F.col("et_i") + F.col("a_o") * F.col("et_o"),
        "e1": F.col("etp") * (F.col("a_v") * F.col("kc") + F.col("a_s") * F.col("kc_min")),
        "r": F.col("runoff_coef") * (F.col("precipitation") - F.col("itp")),
        "spare": (F.col("precipitation") - F.col("et_o")) * flag(F.col("precipitation") > F.col("et_o")),
        "land": land,
    }
    if smooth:
        month["to_flow"] = soil.discharge_m3s(F.lit(1.0), col(p.area), F.col("days_in_month").cast("double"))
    static = {"tsat": F.nullif("tsat", F.lit(0.0)), "wp": F.col("wp"), "k_sat": F.col("k_sat"), "dry": F.nullif(ln(F.col("fc") - F.col("wp") + 1), F.lit(0.0))}
    static["inv"] = ratio(F.lit(1.0), F.col("bulk_density") * F.col("rootzone_depth") * 10 * F.col("tsat"))
    fixed = {k: getattr(p, k) for k in ("alpha_gw", "beta", "f", "bfw_lim", "x")}
    static |= {k: F.col(v) for k, v in fixed.items() if isinstance(v, str)}
    start = {"smc": F.col("tsat") * col(p.t_ini), "sat": col(p.s_sat_ini), "bfw": col(p.bfw_ini)}
    if state is not None:
        rows = rows.drop("smc", "sat", "bfw").join(state.select(*by, "cell_id", "smc", "sat", "bfw"), [*by, "cell_id"], "left")
        start = {k: F.col(k) for k in start}
    numbers = static | start
    flat = rows.select(*by, "cell_id", *[c for c in dict.fromkeys(("block", *hand_on)) if c != "cell_id"], (F.col("cell_id") % PARTS).alias("_part"), F.col("step").cast("int").alias("step"), *[c.cast("double").alias(f"_m_{k}") for k, c in month.items()], *[c.cast("double").alias(f"_c_{k}") for k, c in numbers.items()])
    out = (*TERMS, *(["flow"] if smooth else []))
    same = {k: float(v) for k, v in fixed.items() if k not in static}
    keys = list(dict.fromkeys([*by, "cell_id", *(hand_on if packed else ())]))
    monthly, own = tuple(month), tuple(numbers)

    def run(table: pa.Table) -> pa.Table:
        values = {c: table.column(c).to_numpy() for c in table.column_names if c[:3] in ("_m_", "_c_")}
        step, parts = table.column("step").to_numpy(), []
        with np.errstate(invalid="ignore", divide="ignore"):
            for ids, at in _by_months(table):
                first = at[:, 0]
                c = {k: values[f"_c_{k}"][first].astype(np.float64) for k in own} | {k: np.full(len(ids), v) for k, v in same.items()}
                got = fold_months({k: values[f"_m_{k}"][at].astype(np.float64) for k in monthly}, c, smooth)
                rows_ = pa.array(first if packed else at.ravel())
                columns = [table.column(k).combine_chunks().take(rows_) for k in keys]
                ends = pa.array(np.arange(len(ids) + 1) * at.shape[1], pa.int32())
                listed = (lambda v: pa.ListArray.from_arrays(ends, v)) if packed else (lambda v: v)
                columns += [listed(pa.array(step[at].ravel().astype(np.int32)))] + [listed(pa.array(v := got[k].ravel(), mask=np.isnan(v))) for k in out]
                parts.append(pa.Table.from_arrays(columns, names=[*keys, "step", *out]))
        return pa.concat_tables(parts)

    kinds = ", ".join(f"{k} {t}" for k, t in flat.select(*keys).dtypes)
    kind = "array<{}>" if packed else "{}"
    return flat.groupBy("block", "_part", *by).applyInArrow(run, f"{kinds}, step {kind.format('int')}, " + ", ".join(f"{k} {kind.format('double')}" for k in out))


def _divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b == 0, np.nan, a / b)


def _known(condition: np.ndarray, *of: np.ndarray) -> np.ndarray:
    """1 or 0, NaN where an operand is unknown."""
    return np.where(sum(of[1:], of[0]) * 0 == 0, condition, np.nan)


def free_months(v: dict[str, np.ndarray], p: Parameters) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """What ``fold_months`` takes, by the formulas of ``state_free``, for arrays: cells x months of forcing and land-use attributes, months of the calendar, cells x 1 of what cells have."""
    sr = lambda n: _divided(1 + n, 1 - n)
    log10 = lambda x: np.where(x > 0, np.log10(x), np.nan)
    rain, etp, ndvi, days = v["precipitation"], v["etp"], v["ndvi"], v["days"]
    low = sr(v["ndvi_min"])
    fpar = np.minimum(_divided((sr(ndvi) - low) * (p.fpar_max - p.fpar_min), sr(v["ndvi_max"]) - low) + p.fpar_min, p.fpar_max)
    lai = _divided(p.lai_max * log10(1 - fpar), log10(np.float64(1 - p.fpar_max)))
    full = p.alpha * lai
    held = full * (1 - _divided(1.0, 1 + _divided(rain * (1 - np.exp(-0.463 * lai)), full)))
    itp = v["a_v"] * rain * (1 - np.exp(-_divided(held * days, rain + 1e-5)))
    limit = 1.1 * v["ndvi_min"]
    crop = v["kc_min"] + (v["kc_max"] - v["kc_min"]) * _divided(ndvi - v["ndvi_min"], v["ndvi_max"] - v["ndvi_min"])
    kc = _known(ndvi > limit, ndvi, limit) * crop + _known(ndvi < limit, ndvi, limit) * v["kc_min"]
    open_ = _divided(etp, v["kp"])
    capped = _known((open_ > rain) & (v["a_o"] == 1), open_, rain, v["a_o"])
    et_o = rain * capped + open_ * (1 - capped)
    et_i = p.i_imp * _known(rain != 0, rain)
    deep = v["bulk_density"] * v["rootzone_depth"] * 10
    theta = _divided(v["t_wp"] * v["bulk_density"] * v["rootzone_depth"] * 10, deep)
    share = v["a_o"] + v["a_i"]
    permeable = p.w_1 * _divided(0.02, v["manning"]) + p.w_2 * _divided(theta, 1 - theta) + p.w_3 * _divided(v["slope"], 10 + v["slope"])
    weighted = (1 - share) * permeable + share * 0.09 * np.exp(2.4 * share)
    per_day = weighted * _divided(rain, days)
    net = rain - itp
    month = {
        "itp": itp, "net": net, "e0": v["a_i"] * et_i + v["a_o"] * et_o, "e1": etp * (v["a_v"] * kc + v["a_s"] * v["kc_min"]),
        "r": _divided(per_day, per_day - p.rcd * weighted + p.rcd) * net, "spare": (rain - et_o) * _known(rain > et_o, rain, et_o), "land": _known(v["a_o"] != 1, v["a_o"]),
        "to_flow": np.broadcast_to(p.area * 0.001 / (v["days_in_month"] * 86400.0), rain.shape),
    }
    tsat, wp, fc = ((v[k] * v["bulk_density"] * v["rootzone_depth"] * 10)[:, 0] for k in ("t_sat", "t_wp", "t_fcap"))
    dry = np.where(fc - wp + 1 > 0, np.log(fc - wp + 1), np.nan)
    cell = {"tsat": np.where(tsat == 0, np.nan, tsat), "wp": wp, "k_sat": v["k_sat"][:, 0], "dry": np.where(dry == 0, np.nan, dry), "inv": _divided(1.0, deep[:, 0] * tsat)}
    cell |= {k: np.full(len(tsat), float(getattr(p, k))) for k in ("alpha_gw", "beta", "f", "bfw_lim", "x")}
    return month, cell | {"smc": tsat * p.t_ini, "sat": np.full(len(tsat), p.s_sat_ini), "bfw": np.full(len(tsat), p.bfw_ini)}


def class_arrays(table: DataFrame, code: str, most: int = 100_000) -> dict[str, np.ndarray]:
    """A class, month or soil table as arrays in order of its code; a table of more than ``most`` rows is a ValueError, as it's no class table."""
    rows = table.orderBy(code).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows by {code}")
    return {c: np.array([np.nan if r[c] is None else r[c] for r in rows], np.float64) for c in table.columns}


def _looked_up(classes: dict[str, np.ndarray], code: str, at: np.ndarray) -> dict[str, np.ndarray]:
    """The attributes of codes; NaN for a code that the table lacks."""
    codes = classes[code]
    place = np.minimum(np.searchsorted(codes, at), max(0, len(codes) - 1))
    known = codes[place] == at if len(codes) else np.zeros(at.shape, bool)
    return {k: np.where(known, c[place] if len(codes) else np.nan, np.nan) for k, c in classes.items() if k != code}


FORCED = ("precipitation", "etp", "kp", "ndvi", "landuse")
FIXED = ("soil", "ndvi_min", "ndvi_max", "slope")


def basin_fold(stored: DataFrame, soil_attr: DataFrame, landuse_attr: DataFrame, months: DataFrame, sets: list[Parameters], key: str | None = None, smooth: bool = False, hand_on: tuple[str, ...] = (), packed: bool = False) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]:
    """What ``fold_basin`` groups by block and _part, the function that folds such a group, and the columns that come out."""
    if key is None and len(sets) != 1:
        raise ValueError("several parameter sets need a key")
    soils, lands, dates = class_arrays(soil_attr, "soil"), class_arrays(landuse_attr, "landuse"), class_arrays(months.select("step", "days", "days_in_month"), "step")
    out = (*TERMS, *(["flow"] if smooth else []))
    keys = list(dict.fromkeys(["cell_id", *(hand_on if packed else ())]))
    flat = stored.select(*dict.fromkeys(["block", *keys]), (F.col("cell_id") % PARTS).alias("_part"), F.col("step").cast("int").alias("step"), *[F.col(c).cast("double").alias(f"_{c}") for c in (*FORCED, *FIXED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        values = {c: table.column(f"_{c}").to_numpy() for c in (*FORCED, *FIXED)}
        step = table.column("step").to_numpy()
        for ids, at in _by_months(table):
            first, steps = at[:, 0], step[at]
            v = {c: values[c][at] for c in FORCED} | {c: values[c][first][:, None] for c in FIXED}
            v |= _looked_up(lands, "landuse", v["landuse"]) | _looked_up(soils, "soil", v["soil"]) | _looked_up(dates, "step", steps)
            columns = [table.column(k).combine_chunks().take(pa.array(first if packed else at.ravel())) for k in keys]
            ends = pa.array(np.arange(len(ids) + 1) * at.shape[1], pa.int32())
            listed = (lambda x, ends=ends: pa.ListArray.from_arrays(ends, x)) if packed else (lambda x: x)
            columns.append(listed(pa.array(steps.ravel().astype(np.int32))))
            for number, p in enumerate(sets, 1):
                with np.errstate(invalid="ignore", divide="ignore"):
                    got = fold_months(*free_months(v, p), smooth)
                named = [] if key is None else [pa.array(np.full(len(columns[0]), number, np.int32))]
                yield pa.RecordBatch.from_arrays([*named, *columns, *[listed(pa.array(x := got[k].ravel(), mask=np.isnan(x))) for k in out]], names=[*([] if key is None else [key]), *keys, "step", *out])

    kind = "array<{}>" if packed else "{}"
    kinds = [*([] if key is None else [f"{key} int"]), *[f"{k} {t}" for k, t in flat.select(*keys).dtypes], f"step {kind.format('int')}", *[f"{k} {kind.format('double')}" for k in out]]
    return flat, run, ", ".join(kinds)

def fold_basin(stored: DataFrame, soil_attr: DataFrame, landuse_attr: DataFrame, months: DataFrame, sets: list[Parameters], key: str | None = None, smooth: bool = False, hand_on: tuple[str, ...] = (), packed: bool = False) -> DataFrame:
    """All monthly terms of a basin from ``store_basin`` for each parameter set: (key, cell_id, step, terms) as of ``water_balance``.

    The rows of a block of cells come together once, where they lie, without a shuffle, and the sets are run on them one after
    the other: what is read and moved doesn't grow with their number. ``key`` names the column of the set's number, from 1; without it there is one set.
    A block's cells come in groups of 1024. Classes go to the tasks as arrays.
    """
    flat, run, kinds = basin_fold(stored, soil_attr, landuse_attr, months, sets, key, smooth, hand_on, packed)
    return flat.groupBy("block", "_part").applyInArrow(run, kinds)


def last_state(outputs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The state at the end of the last month of each cell: (*by, cell_id, smc, sat, bfw)."""
    return outputs.groupBy(*by, "cell_id").agg(F.max_by(F.struct("smc", "sat", "bfw"), "step").alias("s")).select(*by, "cell_id", "s.*")
