"""Registered queries on the test basin, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evapo, soil, vegetation
from ..functions import runoff
from ..operators import balance, calibrate, interpolate, lookup, network, quality, series, stations, terrain
from ..operators.balance import TERMS
from ..operators.calendar import calendar, clip_period, with_rainy_days
from ..operators.storage import checkpointed
from ..params import Outputs, valid_parameters
from ..sources.tables import layer_name
from . import basin, testgrid
from .oracle import GAMMA, GREAT_CIRCLE, PARTS, sql
from .oracle import SETS as PARAM_SETS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
P = testgrid.PARAMS


def query(select: str | None = None, *parts: str):
    """Registers a query under its function's name, with SQL over the named parts."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if select:
            ORACLE[f.__name__] = sql(select, *parts)
        return f

    return put


def _r(c, digits: int = 4):
    return F.round(c, digits)


def _months(spark, sf_dir):
    return basin.stored_months(testgrid.stored(spark, sf_dir), testgrid.soil_attr(spark), testgrid.landuse_attr(spark), testgrid.months(spark))


def _free(spark, sf_dir):
    return balance.state_free(_months(spark, sf_dir), P)


def _drain(spark, sf_dir):
    """The network of the stored basin; every cell has a first month."""
    return testgrid.stored(spark, sf_dir).where("step = 1").select("cell_id", *network.NETWORK)


def _classes(spark):
    return testgrid.soil_attr(spark), testgrid.landuse_attr(spark), testgrid.months(spark)


def _outputs(spark, sf_dir):
    return basin.run_stored(testgrid.stored(spark, sf_dir), *_classes(spark), P)


@query(f"SELECT step, {', '.join(f'round(avg({c}), 6) AS {c}' for c in TERMS)}, count(*) AS n FROM balance GROUP BY step", "balance")
def water_balance(spark, sf_dir):
    out = balance.fold_basin(testgrid.stored(spark, sf_dir), *_classes(spark), [P])
    return out.groupBy("step").agg(*[_r(F.avg(c), 6).alias(c) for c in TERMS], F.count("*").alias("n"))


@query(f"SELECT cell_id, step, {', '.join(f'round({c}, 3) AS {c}' for c in TERMS)} FROM balance", "balance")
def water_balance_cells(spark, sf_dir):
    out = balance.water_balance(_free(spark, sf_dir), P)
    return out.select("cell_id", "step", *[_r(F.col(c), 3).alias(c) for c in TERMS])


@query(f"SELECT step, {', '.join(f'round(avg({c}), 6) AS {c}' for c in TERMS)}, count(*) AS n FROM balance WHERE step > 6 GROUP BY step", "balance")
def water_balance_restart(spark, sf_dir):
    rows = _free(spark, sf_dir)
    first = balance.water_balance(clip_period(rows, 1, 6), P)
    out = balance.water_balance(clip_period(rows, 7, 12), P, balance.last_state(first))
    return out.groupBy("step").agg(*[_r(F.avg(c), 6).alias(c) for c in TERMS], F.count("*").alias("n"))


STATEFUL = ("eta", "srn", "lfw", "rec", "bfw", "smc", "sat")


@query(f"SELECT cell_id, step, {', '.join(f'round({c}, 3) AS {c}' for c in STATEFUL)} FROM balance WHERE step > 1", "balance")
def monthly_terms(spark, sf_dir):
    """Each month once more, from the state that the fold left the month before, by the published functions."""
    free = checkpointed(_free(spark, sf_dir))
    state = balance.water_balance(free, P).select("cell_id", (F.col("step") + 1).alias("step"), F.col("smc").alias("s"), F.col("sat").alias("g"), F.col("bfw").alias("b"))
    rows = free.join(state, ["cell_id", "step"])
    ks = evapo.water_stress("s", "wp", "fc")
    rows = rows.withColumn("eta", evapo.total_et("a_v", evapo.et_vegetated("etp", "kc", ks), "a_i", "et_i", "a_o", "et_o", "a_s", evapo.et_bare_soil("etp", "kc_min", ks)))
    ch = runoff.soil_moisture_coef("s", "bulk_density", "rootzone_depth", "tsat", P.beta)
    rows = rows.withColumns({"srn": runoff.surface_runoff("runoff_coef", ch, "precipitation", "itp", "a_o", "et_o", "s", "tsat"), "lfw": soil.lateral_flow(P.f, "k_sat", "s", "tsat"), "rec": soil.recharge(P.f, "k_sat", "s", "tsat")})
    rows = rows.withColumn("bfw", soil.baseflow("b", P.alpha_gw, "rec", "g", P.bfw_lim))
    rows = rows.withColumns({"smc": soil.soil_moisture("s", "precipitation", "itp", "srn", "lfw", "rec", "eta", "a_o", "tsat"), "sat": soil.saturated_storage("g", "rec", "bfw")})
    return rows.select("cell_id", "step", *[_r(F.col(c), 3).alias(c) for c in STATEFUL])


FREE = ("fpar", "lai", "itp", "kc", "et_o", "et_i", "runoff_coef")


@query(f"SELECT landuse, step, {', '.join(f'round(avg({c}), 6) AS {c}' for c in FREE)} FROM free GROUP BY landuse, step", "free")
def state_free_terms(spark, sf_dir):
    return _free(spark, sf_dir).groupBy("landuse", "step").agg(*[_r(F.avg(c), 6).alias(c) for c in FREE])


@query(
    "SELECT soil, round(avg(t_sat * bulk_density * rootzone_depth * 10), 6) AS tsat, round(avg(t_wp * bulk_density * rootzone_depth * 10), 6) AS wp, round(avg(t_fcap * bulk_density * rootzone_depth * 10), 6) AS fc, count(*) AS n"
    " FROM cells JOIN soil_attr USING (soil) GROUP BY soil",
    "cells", "soil_attr",
)
def soil_capacities(spark, sf_dir):
    out = balance.with_soil(testgrid.cells(spark, sf_dir), testgrid.soil_attr(spark))
    return out.groupBy("soil").agg(*[_r(F.avg(c), 6).alias(c) for c in ("tsat", "wp", "fc")], F.count("*").alias("n"))


@query(
    "SELECT step, round(sum(etp * (0.482 + 0.024 * ln(100 + cell_id % 50) - 0.000376 * (etp / 10) + 0.0045 * (40 + cell_id % 50))), 4) AS pan,"
    " round(sum(etp * kp * ln(greatest(precipitation - 100, 0) + 1) / ln(201)), 4) AS et_v FROM forcing GROUP BY step",
    "forcing",
)
def pan_and_stress(spark, sf_dir):
    rows = testgrid.forcing(spark, sf_dir)
    kp = evapo.pan_coefficient(100.0 + F.col("cell_id") % 50, F.col("etp") / 10, 40.0 + F.col("cell_id") % 50)
    ks = evapo.water_stress("precipitation", 100.0, 300.0)
    return rows.groupBy("step").agg(_r(F.sum(F.col("etp") * kp)).alias("pan"), _r(F.sum(evapo.et_vegetated("etp", "kp", ks))).alias("et_v"))


@query("SELECT step, round(sum(q), 4) AS discharge FROM flow GROUP BY step", "flow")
def cell_discharge(spark, sf_dir):
    out = balance.fold_basin(testgrid.stored(spark, sf_dir), *_classes(spark), [P]).join(F.broadcast(testgrid.months(spark)), "step")
    mm = soil.cell_discharge_mm("srn", "lfw", "bfw")
    return out.groupBy("step").agg(_r(F.sum(soil.discharge_m3s(mm, P.area, F.col("days_in_month").cast("double")))).alias("discharge"))


@query("SELECT code, count(*) AS n, round(sum(neighbour_value - value), 4) AS lift FROM nb GROUP BY code", "nb")
def neighbour_pairs(spark, sf_dir):
    near = terrain.neighbours(testgrid.cells(spark, sf_dir))
    return near.groupBy("code").agg(F.count("*").alias("n"), _r(F.sum(F.col("neighbour_value") - F.col("value"))).alias("lift"))


@query("SELECT cell_id, round(slope, 8) AS slope FROM slope", "slope")
def slope(spark, sf_dir):
    return terrain.slope(testgrid.cells(spark, sf_dir), P.grid).select("cell_id", _r(F.col("slope"), 8).alias("slope"))


@query("SELECT cell_id, ldd FROM ldd", "ldd")
def drain_direction(spark, sf_dir):
    return terrain.drain_direction(testgrid.cells(spark, sf_dir))


@query("SELECT cell_id, down_id FROM drain", "drain")
def drain_edges(spark, sf_dir):
    cells = testgrid.cells(spark, sf_dir)
    return terrain.drain_edges(cells.join(terrain.drain_direction(cells), "cell_id")).select("cell_id", "down_id")


@query(
    """SELECT cell_id, round(h, 6) AS filled FROM (
        WITH RECURSIVE ground AS MATERIALIZED (SELECT cell_id, r, c, CASE WHEN cell_id % 37 = 3 THEN dem - 5 ELSE dem END AS z FROM cells),
        near AS MATERIALIZED (SELECT n.cell_id, n.neighbour_id, g.z FROM nb n JOIN ground g ON g.cell_id = n.neighbour_id),
        water(cell_id, h) USING KEY (cell_id) AS (
            SELECT cell_id, z FROM ground WHERE cell_id NOT IN (SELECT cell_id FROM nb GROUP BY cell_id HAVING count(*) = 8)
            UNION
            SELECT n.neighbour_id, min(greatest(n.z, w.h)) AS h FROM water w JOIN near n ON n.cell_id = w.cell_id LEFT JOIN recurring.water k ON k.cell_id = n.neighbour_id
            WHERE k.h IS NULL OR greatest(n.z, w.h) < k.h GROUP BY n.neighbour_id)
        SELECT cell_id, h FROM water)""",
    "cells", "nb",
)
def fill_depressions(spark, sf_dir):
    cells = testgrid.cells(spark, sf_dir)
    pitted = cells.withColumn("dem", F.when(F.col("cell_id") % 37 == 3, F.col("dem") - 5).otherwise(F.col("dem")))
    return terrain.fill_depressions(pitted).select("cell_id", _r(F.col("filled"), 6).alias("filled"))


@query("SELECT b.at AS cell_id, f.step, round(sum(f.precipitation), 4) AS value FROM below b JOIN forcing f ON f.cell_id = b.cell_id GROUP BY b.at, f.step", "below", "forcing")
def flow_accumulation(spark, sf_dir):
    flux = testgrid.stored(spark, sf_dir).select("cell_id", "step", *network.NETWORK, F.col("precipitation").alias("value"))
    return network.accumulate(None, flux).select("cell_id", "step", _r(F.col("value")).alias("value"))


@query(
    "SELECT c.station_id, f.step, round(sum(f.precipitation), 4) AS value FROM cells c JOIN below b ON b.at = c.cell_id JOIN forcing f ON f.cell_id = b.cell_id WHERE c.station_id IS NOT NULL GROUP BY c.station_id, f.step",
    "cells", "below", "forcing",
)
def gauge_flow(spark, sf_dir):
    flux = testgrid.stored(spark, sf_dir).select("cell_id", "step", F.col("precipitation").alias("value"))
    return network.accumulate_at_gauges(_drain(spark, sf_dir), stations.stations_of(testgrid.cells(spark, sf_dir)), flux).select("station_id", "step", _r(F.col("value")).alias("value"))


@query("SELECT cell_id, step, round(q, 8) AS smooth FROM smooth WHERE step > 0", "smooth")
def recession_smooth(spark, sf_dir):
    out = balance.fold_basin(testgrid.stored(spark, sf_dir), *_classes(spark), [P], packed=True)
    days = testgrid.months(spark).agg(F.map_from_entries(F.collect_list(F.struct("step", F.col("days_in_month").cast("double")))).alias("days"))
    flow = lambda m: F.struct(m["step"].alias("step"), soil.discharge_m3s(m["rnf"], P.area, F.col("days")[m["step"]]).alias("v"))
    cells = out.crossJoin(F.broadcast(days)).select("cell_id", F.transform(F.arrays_zip("step", "rnf"), flow).alias("s"))
    return network.smooth_packed(cells, P.x).select("cell_id", "step", _r(F.col("smooth"), 8).alias("smooth"))


@query("SELECT cell_id, step, round(rnf, 4) AS rnf, round(arn, 4) AS arn FROM balance JOIN arn USING (cell_id, step)", "balance", "arn")
def run_basin(spark, sf_dir):
    return _outputs(spark, sf_dir).select("cell_id", "step", _r(F.col("rnf")).alias("rnf"), _r(F.col("arn")).alias("arn"))


STATION_SQL = """SELECT v.variable, step, station_id, round(CASE v.variable WHEN 'itp' THEN itp WHEN 'bfw' THEN bfw WHEN 'srn' THEN srn WHEN 'eta' THEN eta WHEN 'lfw' THEN lfw WHEN 'rec' THEN rec WHEN 'smc' THEN smc WHEN 'rnf' THEN rnf WHEN 'arn' THEN arn END, 3) AS value
    FROM balance JOIN arn USING (cell_id, step) JOIN cells USING (cell_id) CROSS JOIN (VALUES ('itp'), ('bfw'), ('srn'), ('eta'), ('lfw'), ('rec'), ('smc'), ('rnf'), ('arn')) AS v(variable) WHERE station_id IS NOT NULL"""


def _samples(spark, sf_dir):
    at = stations.stations_of(testgrid.cells(spark, sf_dir))
    return stations.sample_stations(_outputs(spark, sf_dir), at).withColumn("value", _r(F.col("value"), 3))


def _station_ids(spark, sf_dir) -> list[int]:
    return [r.station_id for r in stations.station_ids(testgrid.cells(spark, sf_dir)).collect()]


@query(STATION_SQL, "balance", "arn", "cells")
def station_series(spark, sf_dir):
    return _samples(spark, sf_dir)


@query(STATION_SQL, "balance", "arn", "cells")
def station_report(spark, sf_dir):
    """All stations side by side, and back to rows for the comparison."""
    ids = _station_ids(spark, sf_dir)
    wide = stations.side_by_side(_samples(spark, sf_dir), ids)
    places = spark.createDataFrame(list(enumerate(sorted(ids))), "_place int, station_id int")
    long = wide.select("variable", "step", F.posexplode("values").alias("_place", "value")).join(F.broadcast(places), "_place")
    return long.select("variable", "step", "station_id", "value")


@query("SELECT DISTINCT station_id FROM cells WHERE station_id IS NOT NULL", "cells")
def station_ids(spark, sf_dir):
    return stations.station_ids(testgrid.cells(spark, sf_dir))


@query("SELECT cell_id, min(ndvi) AS min, max(ndvi) AS max FROM forcing GROUP BY cell_id", "forcing")
def series_min_max(spark, sf_dir):
    return series.series_min_max(testgrid.forcing(spark, sf_dir).select("cell_id", F.col("ndvi").alias("value")))


@query('SELECT series, step, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS n, count(*) - count(value) AS n_nodata FROM long GROUP BY series, step', "long")
def raster_stats(spark, sf_dir):
    out = series.raster_stats(testgrid.series(testgrid.forcing(spark, sf_dir)))
    return out.select("series", "step", *[_r(F.col(c), 6).alias(c) for c in ("min", "max", "mean", "std")], "n", "n_nodata")


BROKEN = "CASE WHEN series = 'kp' AND step = 3 AND cell_id = 7 THEN 1.5 WHEN series = 'etp' AND step = 2 AND cell_id = 9 THEN NULL WHEN series = 'landuse' AND step = 4 THEN 0 ELSE value END"


@query(
    f"""SELECT layer, step, band, CASE WHEN outside THEN 'FORBID_OUT_OF_RANGE' WHEN nodata THEN 'FORBID_NO_DATA' WHEN zeroes AND layer = 'landuse' THEN 'FORBID_ALL_ZEROES' END AS violation FROM (
        SELECT series AS layer, step, 1 AS band,
            bool_or(coalesce(value < CASE series WHEN 'ndvi' THEN -1 ELSE 0 END OR (series IN ('kp', 'ndvi') AND value > 1), false)) AS outside, bool_or(value IS NULL) AS nodata, bool_and(coalesce(abs(value) <= 1e-8, false)) AS zeroes
        FROM (SELECT series, step, {BROKEN} AS value FROM long) GROUP BY series, step)
    UNION ALL SELECT 'samples', 0, 1, CASE WHEN bool_and(soil > 0) THEN 'FORBID_ALL_ONES' END FROM cells""",
    "long", "cells",
)
def validate_layers(spark, sf_dir):
    long = testgrid.series(testgrid.forcing(spark, sf_dir)).union(testgrid.cells(spark, sf_dir).select(F.lit("samples"), F.lit(0), "cell_id", (F.col("soil") > 0).cast("double")))
    layers = long.select(F.col("series").alias("layer"), "step", F.lit(1).alias("band"), F.expr(BROKEN).alias("value"))
    return quality.validate_layers(layers)


@query("SELECT series, count(DISTINCT step) AS n_steps, false AS consistent FROM long WHERE NOT (series = 'ndvi' AND step > 10) GROUP BY series", "long")
def series_lengths(spark, sf_dir):
    return series.series_lengths(testgrid.series(testgrid.forcing(spark, sf_dir)).where("not (series = 'ndvi' and step > 10)"))


@query("SELECT DISTINCT landuse FROM forcing WHERE landuse NOT IN (3, 4, 33)", "forcing")
def uncovered_classes(spark, sf_dir):
    table = testgrid.landuse_attr(spark).where("landuse in (3, 4, 33)")
    return lookup.uncovered_classes(testgrid.forcing(spark, sf_dir), "landuse", table)


@query("SELECT cell_id, step, precipitation, etp, kp, ndvi, landuse FROM forcing", "forcing")
def align_series(spark, sf_dir):
    return series.align_series(testgrid.series(testgrid.forcing(spark, sf_dir)))


@query(
    "SELECT f.cell_id, s.step, f.ndvi FROM (VALUES (3), (4), (5), (6), (7), (8), (9), (10), (11), (12)) AS s(step)"
    " JOIN forcing f ON f.step = CASE WHEN s.step IN (5, 6) THEN 4 WHEN s.step = 11 THEN 10 ELSE s.step END WHERE s.step > 3",
    "forcing",
)
def carry_forward(spark, sf_dir):
    some = testgrid.forcing(spark, sf_dir).select("cell_id", "step", "ndvi").where("step not in (3, 5, 6, 11)")
    return series.carry_forward(some, 3, 12)


@query("SELECT s.step FROM (VALUES (1), (2), (3), (4), (5), (6)) AS s(step) WHERE s.step NOT IN (SELECT DISTINCT step FROM forcing WHERE step % 3 <> 0)", "forcing")
def missing_steps(spark, sf_dir):
    return series.missing_steps(testgrid.forcing(spark, sf_dir).where("step % 3 != 0").select("step"), 1, 6)


@query("SELECT step, count(*) AS n, round(sum(precipitation), 4) AS rain FROM forcing JOIN cells USING (cell_id) WHERE mask AND step BETWEEN 4 AND 9 GROUP BY step", "forcing", "cells")
def clip_window_and_mask(spark, sf_dir):
    inside = series.clip_to_mask(clip_period(testgrid.forcing(spark, sf_dir), 4, 9), testgrid.cells(spark, sf_dir))
    return inside.groupBy("step").agg(F.count("*").alias("n"), _r(F.sum("precipitation")).alias("rain"))


@query("SELECT r AS \"row\", c AS col, cell_id, soil::DOUBLE AS value FROM cells", "cells")
def dense_round_trip(spark, sf_dir):
    dense = series.cells_to_dense(testgrid.cells(spark, sf_dir).select("row", "col", F.col("soil").cast("double").alias("value")))
    return series.dense_to_cells(dense, 100)


@query("SELECT cell_id, step, CASE WHEN cell_id % 13 = 0 THEN -9999.0 ELSE ndvi END AS stored, CASE WHEN cell_id % 13 = 0 THEN NULL ELSE ndvi END AS value, (ndvi * 10 - 0.5 * (ndvi * 10 < 0)::INT)::INT * 0 + trunc(ndvi * 10)::INT AS nominal, ndvi * 10 <> 0 AS flag FROM forcing", "forcing")
def nodata_and_scales(spark, sf_dir):
    rows = testgrid.forcing(spark, sf_dir)
    gone = F.when(F.col("cell_id") % 13 != 0, F.col("ndvi"))
    kept = series.fill_nodata(gone, -9999.0)
    return rows.select(
        "cell_id", "step", kept.alias("stored"), series.null_if_nodata(kept, -9999.0).alias("value"),
        series.to_value_scale(F.col("ndvi") * 10, "nominal").alias("nominal"), series.to_value_scale(F.col("ndvi") * 10, "boolean").alias("flag"),
    )


@query(
    "SELECT DISTINCT step, 'itp' || lpad(step::VARCHAR, 7, '0') || '.tif' AS tif, 'itp' || substr(lpad(step::VARCHAR, 8, '0'), 1, 5) || '.' || substr(lpad(step::VARCHAR, 8, '0'), 6, 3) AS short FROM forcing",
    "forcing",
)
def layer_names(spark, sf_dir):
    steps = testgrid.forcing(spark, sf_dir).select("step").distinct()
    return steps.select("step", layer_name("itp", F.col("step")).alias("tif"), layer_name("itp", F.col("step"), "8.3").alias("short"))


@query("SELECT 'prec' || lpad((step // 1000)::VARCHAR, 4, '0') || '.' || lpad((step % 1000)::VARCHAR, 3, '0') AS name, step::INT AS step FROM (SELECT DISTINCT step * 7 AS step FROM forcing)", "forcing")
def series_catalog(spark, sf_dir):
    steps = testgrid.forcing(spark, sf_dir).select(F.col("step") * 7).distinct().toDF("step")
    names = steps.select(F.concat(F.lit("/maps/"), layer_name("prec", F.col("step"), "8.3")).alias("path"))
    return series.series_catalog(names.union(names.select(F.lit("/maps/other.tif"))), "PREC").select("name", "step")


@query("SELECT series, first, row_number() OVER (PARTITION BY series ORDER BY first) ::INT AS step FROM (SELECT DISTINCT 's' || (landuse % 3)::VARCHAR AS series, landuse AS first FROM forcing)", "forcing")
def assign_steps(spark, sf_dir):
    maps = testgrid.forcing(spark, sf_dir).select(F.concat(F.lit("s"), (F.col("landuse") % 3).cast("string")).alias("series"), F.col("landuse").alias("first")).distinct()
    return series.assign_steps(maps, "first")


@query("SELECT variable, step, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT step, v.variable, CASE v.variable WHEN 'itp' THEN itp WHEN 'rec' THEN rec WHEN 'srn' THEN srn ELSE smc END AS value FROM balance CROSS JOIN (VALUES ('itp'), ('rec'), ('srn'), ('smc')) AS v(variable)) GROUP BY variable, step", "balance")
def stacked_outputs(spark, sf_dir):
    chosen = Outputs(bfw=False, eta=False, lfw=False, rnf=False, arn=False)
    long = stations.stack(balance.water_balance(_free(spark, sf_dir), P), chosen.enabled())
    return long.groupBy("variable", "step").agg(F.count("*").alias("n"), _r(F.sum("value"), 3).alias("total"))


@query(
    "SELECT cell_id, step, round(smc, 3) AS smc, round(rnf, 3) AS rnf FROM balance_gaps", "balance_gaps",
)
def run_with_gaps(spark, sf_dir):
    """A whole run from maps: months without NDVI or land use take the last map; directions are given."""
    maps = testgrid.series(testgrid.forcing(spark, sf_dir, by_cell=True)).where("not (series = 'ndvi' and step in (5, 6)) and not (series = 'landuse' and step = 3)")
    cells = testgrid.cells(spark, sf_dir)
    cells = cells.join(terrain.drain_direction(cells), "cell_id")
    out = basin.run(cells, maps, testgrid.soil_attr(spark), testgrid.landuse_attr(spark), testgrid.months(spark), P, 1, 12, Outputs(itp=False, bfw=False, srn=False, eta=False, lfw=False, rec=False))
    return out.select("cell_id", "step", _r(F.col("smc"), 3).alias("smc"), _r(F.col("rnf"), 3).alias("rnf"))


@query(
    "SELECT step, strftime(DATE '2019-03-01' + to_months(step - 1), '%Y-%m-%d') AS month_start, month(DATE '2019-03-01' + to_months(step - 1))::INT AS month, day(last_day(DATE '2019-03-01' + to_months(step - 1)))::INT AS days_in_month, days"
    " FROM (SELECT DISTINCT step FROM forcing) JOIN (SELECT step AS m, days FROM months) ON m = month(DATE '2019-03-01' + to_months(step - 1))",
    "forcing", "months",
)
def calendar_months(spark, sf_dir):
    from datetime import date

    days = with_rainy_days(calendar(spark, date(2019, 3, 1), date(2020, 2, 1)), testgrid.months(spark).select("month", "days"))
    seen = testgrid.forcing(spark, sf_dir).select("step").distinct()
    return days.join(seen, "step").select("step", F.col("month_start").cast("string").alias("month_start"), "month", "days_in_month", "days")


SETS = "CAST(o_custkey % 30 AS DOUBLE) / 20"


@query(
    f"SELECT o_orderkey, NOT coalesce({SETS} < 0.01 OR {SETS} > 1, false) AS valid, CASE WHEN {SETS} < 0.01 OR {SETS} > 1 THEN 1 ELSE 0 END AS n_problems FROM orders",
)
def valid_parameter_sets(spark, sf_dir):
    sets = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr(SETS).alias("beta"), F.lit(0.25).alias("w_1"), F.lit(0.25).alias("w_2"), F.lit(0.5).alias("w_3"))
    return valid_parameters(sets).select("o_orderkey", "valid", F.size("problems").alias("n_problems"))


_SWEPT = " UNION ALL ".join(f"SELECT {k} AS param_id, b.cell_id, b.step, o.rnf * (1 + 0.02 * (b.step % 5)) AS o, b.rnf AS s FROM balance_{k} b JOIN balance o USING (cell_id, step)" for k in range(1, len(PARAM_SETS) + 1))
_FIT_SQL = f"""SELECT param_id, count(*) AS n, round(sqrt(avg((s - o) ** 2)), 6) AS rmse, round(1 - sum((s - o) ** 2) / (var_pop(o) * count(*)), 6) AS nse, round(corr(o, s), 6) AS r,
        round(avg(s - o), 6) AS mean_error, round(avg(s - o) / avg(o), 6) AS relative_bias FROM ({_SWEPT}) JOIN cells USING (cell_id) WHERE station_id IS NOT NULL GROUP BY param_id"""
_FIT_PARTS = ("balance", "cells", *(f"balance_{k}" for k in range(1, len(PARAM_SETS) + 1)))


def _swept(spark, sf_dir):
    """The model with each parameter set: (param_id, cell_id, step, terms)."""
    return balance.fold_basin(testgrid.stored(spark, sf_dir), *_classes(spark), [replace(P, **x) for x in PARAM_SETS], "param_id")


@query(" UNION ALL ".join(f"SELECT {k} AS param_id, step, {', '.join(f'round(avg({c}), 6) AS {c}' for c in TERMS)} FROM balance_{k} GROUP BY step" for k in range(1, len(PARAM_SETS) + 1)), *_FIT_PARTS[2:])
def swept_balance(spark, sf_dir):
    return _swept(spark, sf_dir).groupBy("param_id", "step").agg(*[_r(F.avg(c), 6).alias(c) for c in TERMS])


@query(_FIT_SQL, *_FIT_PARTS)
def sweep_fit(spark, sf_dir):
    return _fits(spark, sf_dir)


def _fits(spark, sf_dir):
    """How well each set's runoff at the stations fits records, here those of the default parameters with a known error."""
    at = stations.stations_of(testgrid.cells(spark, sf_dir))
    record = balance.water_balance(_free(spark, sf_dir), P).join(at, "cell_id").select("cell_id", "step", (F.col("rnf") * (1 + 0.02 * (F.col("step") % 5))).alias("observed"))
    rows = _swept(spark, sf_dir).withColumnRenamed("rnf", "simulated").join(record, ["cell_id", "step"])
    fits = calibrate.goodness_of_fit(rows, ("param_id",))
    return fits.select("param_id", "n", *[_r(F.col(c), 6).alias(c) for c in ("rmse", "nse", "r", "mean_error", "relative_bias")])


@query(f"SELECT param_id, nse FROM ({_FIT_SQL}) ORDER BY nse DESC LIMIT 2", *_FIT_PARTS)
def best_parameter_sets(spark, sf_dir):
    return calibrate.rank_parameter_sets(_fits(spark, sf_dir), 2).select("param_id", "nse")


@query("SELECT station_id, round(avg(value) * 86400 * 1e-3 / (1e6 * 4), 8) AS bfw_ini, round(min(value) * 86400 * 1e-3 / (1e6 * 4), 8) AS bfw_lim FROM obs GROUP BY station_id", "obs")
def baseflow_seed(spark, sf_dir):
    obs = testgrid.station_obs(spark, sf_dir).select("station_id", F.lit(1e6).alias("area"), F.col("value").alias("flow"))
    return calibrate.baseflow_seed(obs, 86400, 250000).select("station_id", *[_r(F.col(c), 8).alias(c) for c in ("bfw_ini", "bfw_lim")])


@query(
    """SELECT step, lag, round(avg(d), 6) AS distance, round(avg(g), 4) AS gamma, count(*) AS n FROM (
        SELECT step, d, g, least(greatest(ceil(d / max(d) OVER (PARTITION BY step) * 25)::INT, 1), 25) AS lag FROM (
            SELECT a.step, sqrt((a.lon - b.lon) ** 2 + (a.lat - b.lat) ** 2) AS d, (a.value - b.value) ** 2 / 2 AS g FROM obs a JOIN obs b ON a.step = b.step AND a.station_id < b.station_id)) GROUP BY step, lag""",
    "obs",
)
def semivariogram(spark, sf_dir):
    out = interpolate.semivariogram(testgrid.station_obs(spark, sf_dir), geographic=False)
    return out.select("step", "lag", _r(F.col("distance"), 6).alias("distance"), _r(F.col("gamma")).alias("gamma"), "n")


@query("SELECT step, round(span, 6) AS span, round(sill, 2) AS sill, round(nugget, 2) AS nugget FROM model", "model")
def variogram_model(spark, sf_dir):
    """The spherical model of each month by planar distances."""
    out = interpolate.solve_kriging(testgrid.station_obs(spark, sf_dir), geographic=False)
    return out.select("step", _r(F.col("span"), 6).alias("span"), _r(F.col("sill"), 2).alias("sill"), _r(F.col("nugget"), 2).alias("nugget"))


@query("SELECT station_id AS cell_id, step, round(value, 3) AS value FROM spots UNION ALL SELECT station_id, 0, 7.0 FROM spots WHERE step = 1", "spots")
def krige_at_stations(spark, sf_dir):
    """Without a nugget kriging gives each station its own record, and a constant field everywhere; stations lie at places of their own."""
    spots = _spots(spark, sf_dir)
    obs = spots.union(spots.where("step = 1").withColumns({"step": F.lit(0), "value": F.lit(7.0)}))
    cells = spots.where("step = 1").select(F.col("station_id").alias("cell_id"), "lon", "lat")
    return interpolate.krige(obs, cells, nugget=0.0).select("cell_id", "step", _r(F.col("value"), 3).alias("value"))


def _spots(spark, sf_dir):
    """Stations at places of their own, however many: from 2400 on the grid of degrees is taken again, moved by 1/2, 2/3, ... of a degree."""
    turn = F.floor(F.col("station_id") / 2400).cast("double")
    return testgrid.station_obs(spark, sf_dir).select("station_id", (F.col("station_id") % 40 + turn / (turn + 1)).alias("lon"), (F.floor(F.col("station_id") / 40) % 60).cast("double").alias("lat"), "step", F.col("value").cast("double").alias("value"))


@query(
    f"""SELECT cell_id, step, round(greatest(z, 0), 3) AS value FROM (
        SELECT cell_id, step, sum({GAMMA} * dual) + any_value(mean) AS z FROM (
            SELECT a.cell_id, b.step, {GREAT_CIRCLE} AS d, t.span, t.sill, t.nugget, u.dual, v.dual AS mean
            FROM (SELECT cell_id, c / 10 AS lon, r / 40 AS lat FROM cells) a CROSS JOIN placed b JOIN model_geo t ON t.step = b.step
            JOIN duals u ON u.step = b.step AND u.i = b.i JOIN duals v ON v.step = b.step AND v.i = b.m + 1) GROUP BY cell_id, step)""",
    "cells", "placed", "model_geo", "duals",
)
def krige(spark, sf_dir):
    cells = testgrid.cells(spark, sf_dir).select("cell_id", (F.col("col") / 10).alias("lon"), (F.col("row") / 40).alias("lat"))
    return interpolate.krige(testgrid.station_obs(spark, sf_dir), cells).select("cell_id", "step", _r(F.col("value"), 3).alias("value"))


@query()
def krige_nearest(spark, sf_dir):
    """Each cell from its eight nearest stations."""
    cells = testgrid.cells(spark, sf_dir).select("cell_id", (F.col("col") / 10).alias("lon"), (F.col("row") / 40).alias("lat"))
    return interpolate.krige(testgrid.station_obs(spark, sf_dir), cells, nearest=8)


@query(
    """SELECT step, lag, round(avg(d), 6) AS distance, round(avg(g), 4) AS gamma, count(*) AS n FROM (
        SELECT step, d, g, least(greatest(ceil(d / max(d) OVER (PARTITION BY step) * 25)::INT, 1), 25) AS lag FROM (
            SELECT a.step, degrees(2 * asin(least(1.0, sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2)))) AS d, (a.value - b.value) ** 2 / 2 AS g
            FROM obs a JOIN obs b ON a.step = b.step AND a.station_id < b.station_id)) GROUP BY step, lag""",
    "obs",
)
def semivariogram_geographic(spark, sf_dir):
    # the places of the stations are exact degrees, so lags at a bin's very edge are counted alike only up to rounding
    out = interpolate.semivariogram(testgrid.station_obs(spark, sf_dir))
    return out.select("step", "lag", _r(F.col("distance"), 6).alias("distance"), _r(F.col("gamma")).alias("gamma"), "n")


@query("SELECT landuse, abs(a_i + a_o + a_s + a_v - 1) > 1e-9 AS bad_shares, kc_max <= kc_min AS bad_crop_coef FROM landuse_attr WHERE (abs(a_i + a_o + a_s + a_v - 1) > 1e-9 OR kc_max <= kc_min) AND landuse IN (SELECT landuse FROM forcing)", "landuse_attr", "forcing")
def landuse_table_check(spark, sf_dir):
    used = testgrid.landuse_attr(spark).join(testgrid.forcing(spark, sf_dir).select("landuse").distinct(), "landuse", "left_semi")
    return lookup.check_landuse_table(used)


@query(
    """SELECT 'class table rule' AS description, CASE WHEN shares AND crops THEN 'shares, crop coefficients' WHEN shares THEN 'shares' ELSE 'crop coefficients' END AS reason, 'landuse ' || landuse::VARCHAR AS file, false AS blocking
    FROM (SELECT landuse, abs(a_i + a_o + a_s + a_v - 1) > 1e-9 AS shares, kc_max <= kc_min AS crops FROM landuse_attr) WHERE shares OR crops""",
    "landuse_attr",
)
def input_report(spark, sf_dir):
    return quality.input_report(testgrid.cells(spark, sf_dir), testgrid.forcing(spark, sf_dir), testgrid.soil_attr(spark), testgrid.landuse_attr(spark), P)


#: Faults planted in a basin: (column, value, where).
FAULTS = (
    ("precipitation", "-precipitation - 1", "step = 3 AND cell_id % 7 = 1"),
    ("kp", "CAST(NULL AS DOUBLE)", "step = 5 AND cell_id % 64 = 1"),
    ("ndvi", "CAST(1.5 AS DOUBLE)", "step = 2 AND cell_id % 7 = 2"),
    ("ndvi_max", "CAST(NULL AS DOUBLE)", "cell_id % 7 = 3"),
    ("landuse", "99", "step = 6 AND cell_id % 7 = 4"),
)


def _faulty(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.expr(f"CASE WHEN {where} THEN {value} ELSE {c} END") for c, value, where in FAULTS})


PARTS["faulty"] = (
    "forcing cells",
    "SELECT * REPLACE (" + ", ".join(f"CASE WHEN {where} THEN {value} ELSE {c} END AS {c}" for c, value, where in FAULTS) + ") FROM forcing JOIN cells USING (cell_id)",
)
_LIMITS = [(layer, *quality.RULES[layer], "0" if layer in quality.STATIC else "step") for layer in (*quality.STATIC, *quality.MOVING)]


@query(
    f"""SELECT 'map rule' AS description, rule AS reason, layer || ' step ' || step::VARCHAR AS file, true AS blocking FROM (
        SELECT layer, step, CASE WHEN bool_or(v < lo OR v > hi) THEN 'FORBID_OUT_OF_RANGE' WHEN no AND bool_or(v IS NULL) THEN 'FORBID_NO_DATA'
            WHEN zeroes AND bool_and(coalesce(abs(v) <= 1e-8, false)) THEN 'FORBID_ALL_ZEROES' WHEN ones AND bool_and(coalesce(abs(v - 1) <= 1e-8 + 1e-5, false)) THEN 'FORBID_ALL_ONES' END AS rule
        FROM ({" UNION ALL ".join(f"SELECT '{x}' AS layer, {step} AS step, {x}::DOUBLE AS v, '{lo}'::DOUBLE AS lo, '{hi}'::DOUBLE AS hi, {no} AS no, {zeroes} AS zeroes, {ones} AS ones FROM faulty" for x, lo, hi, no, zeroes, ones, step in _LIMITS)})
        GROUP BY layer, step, no, zeroes, ones) WHERE rule IS NOT NULL
    UNION ALL SELECT DISTINCT 'class without a row', soil::VARCHAR, 'soil', true FROM faulty WHERE soil NOT IN (SELECT soil FROM soil_attr)
    UNION ALL SELECT DISTINCT 'class without a row', landuse::VARCHAR, 'landuse', true FROM faulty WHERE landuse NOT IN (SELECT landuse FROM landuse_attr)
    UNION ALL SELECT 'class table rule', concat_ws(', ', CASE WHEN shares THEN 'shares' END, CASE WHEN crops THEN 'crop coefficients' END), 'landuse ' || landuse::VARCHAR, false
        FROM (SELECT landuse, abs(a_i + a_o + a_s + a_v - 1) > 1e-9 AS shares, kc_max <= kc_min AS crops FROM landuse_attr) WHERE shares OR crops""",
    "faulty", "soil_attr", "landuse_attr",
)
def run_report(spark, sf_dir):
    """What a run's own scan of a faulty basin tells of it."""
    soil_attr, landuse_attr, months = _classes(spark)
    seen, watch = quality.watched(_faulty(testgrid.stored(spark, sf_dir)), soil_attr, landuse_attr)
    basin.run_stored(seen, soil_attr, landuse_attr, months, P)
    return quality.watched_report(spark, watch, landuse_attr, P)


#: Rows at which strict formulas raise: NDVI 1 makes the ratio and the log of the leaf area fail.
@query(
    """SELECT cell_id, step, term FROM (SELECT *, CASE WHEN cell_id % 16 = 1 THEN 1.0 ELSE ndvi END AS n, CASE WHEN cell_id % 32 = 2 THEN ndvi_min ELSE ndvi_max END AS most, CASE WHEN cell_id % 64 = 3 THEN 0.0 WHEN cell_id % 64 = 4 THEN NULL ELSE kp END AS k,
            CASE WHEN step = 7 THEN 0.0 ELSE 5.0 END AS wet, CASE WHEN soil = 3 THEN 0.0 ELSE 1.5 END AS density, CASE WHEN soil = 4 THEN 2.0 ELSE -1.0 END AS dry FROM forcing JOIN cells USING (cell_id)) t
        CROSS JOIN (VALUES ('simple_ratio'), ('crop_coef'), ('open_water'), ('rain_per_rainy_day'), ('soil_moisture_coef'), ('water_stress')) AS terms(term)
    WHERE CASE term WHEN 'simple_ratio' THEN n = 1 WHEN 'crop_coef' THEN most = ndvi_min WHEN 'open_water' THEN k = 0 WHEN 'rain_per_rainy_day' THEN wet = 0 WHEN 'soil_moisture_coef' THEN density = 0 ELSE dry >= 1 END""",
    "forcing", "cells",
)
def strict_errors(spark, sf_dir):
    """Each row and term at which ``strict`` raises, over a basin with planted values; where kp is NULL nothing raises."""
    at = lambda where, value, other: F.when(F.expr(where), F.lit(value)).otherwise(F.col(other) if isinstance(other, str) else F.lit(other))
    rows = testgrid.stored(spark, sf_dir).select(
        "cell_id", "step", "precipitation", "etp", "ndvi_min",
        at("cell_id % 16 = 1", 1.0, "ndvi").alias("n"),
        F.when(F.expr("cell_id % 32 = 2"), F.col("ndvi_min")).otherwise(F.col("ndvi_max")).alias("most"),
        F.when(F.expr("cell_id % 64 = 4"), None).otherwise(at("cell_id % 64 = 3", 0.0, "kp")).alias("k"),
        at("step = 7", 0.0, 5.0).alias("wet"), at("soil = 3", 0.0, 1.5).alias("density"), at("soil = 4", 2.0, -1.0).alias("dry"),
    )
    terms = {
        "simple_ratio": (vegetation.simple_ratio("n"), ("n",)),
        "crop_coef": (vegetation.crop_coef(0.5, "ndvi_min", "most", 0.4, 0.9), ("ndvi_min", "most")),
        "open_water": (evapo.et_open_water("etp", "k", "precipitation", 1.0), ("etp", "k", "precipitation")),
        "rain_per_rainy_day": (runoff.rain_per_rainy_day("precipitation", "wet"), ("precipitation", "wet")),
        "soil_moisture_coef": (runoff.soil_moisture_coef(1.0, "density", 1.0, 1.0, 1.0), ("density",)),
        "water_stress": (evapo.water_stress(1.0, "dry", 1.0), ("dry",)),
    }
    return quality.domain_errors(rows, terms, ("cell_id", "step"))


@query(
    "SELECT step, round(avg(a_v), 6) AS a_v, round(avg(simple), 6) AS simple FROM (SELECT step, a_v, (1 + ndvi) / (1 - ndvi) AS simple FROM forcing JOIN landuse_attr USING (landuse)) GROUP BY step",
    "forcing", "landuse_attr",
)
def landuse_lookup(spark, sf_dir):
    rows = balance.with_landuse(testgrid.forcing(spark, sf_dir), testgrid.landuse_attr(spark))
    return rows.groupBy("step").agg(_r(F.avg("a_v"), 6).alias("a_v"), _r(F.avg(vegetation.simple_ratio("ndvi")), 6).alias("simple"))
