"""The fold, networks, series, calendar, parameters and files on small tables."""

import heapq
import math
import random
from dataclasses import replace
from datetime import date

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rainfold.functions import runoff, vegetation
from rainfold.operators import calendar, calibrate, interpolate, lookup, network, quality, series, stations, storage, terrain
from rainfold.operators.balance import fold_basin, last_state, state_free, water_balance
from rainfold.params import Outputs, ParameterColumns, Parameters, valid_parameters
from rainfold.plans import basin, testgrid
from rainfold.plans.queries import QUERIES
from rainfold.sources import tables


def test_calendar(spark):
    d = date
    assert calendar.period(d(2024, 1, 1), d(2024, 3, 1)) == (1, 3, 3)
    assert calendar.period(d(2020, 1, 1), d(2024, 12, 1)) == (1, 60, 60)
    assert calendar.period(d(2024, 1, 1), d(2024, 12, 1), d(2019, 1, 1)) == (61, 72, 12)
    assert calendar.period(d(2021, 1, 1), d(2024, 3, 1), d(2019, 1, 1)) == (25, 63, 39)
    for bad in ((d(2024, 1, 1), d(2024, 1, 1)), (d(2024, 1, 1), d(2024, 5, 1), d(2024, 2, 1))):
        with pytest.raises(ValueError):
            calendar.period(*bad)
    rows = calendar.with_rainy_days(calendar.calendar(spark, d(2000, 2, 1), d(2000, 3, 1)), spark.createDataFrame(testgrid.RAINY_DAYS, "month int, days int")).orderBy("step").collect()
    assert [(r.step, r.month, r.days_in_month, r.days) for r in rows] == [(1, 2, 29, 13), (2, 3, 31, 12)]


def test_parameters(spark):
    assert Parameters().problems() == []
    assert Parameters(alpha=11.0, w_1=0.5, fpar_min=0.96, grid=0.0).problems() and len(Parameters(alpha=11.0, w_1=0.5, fpar_min=0.96, grid=0.0).problems()) == 4
    with pytest.raises(ValueError):
        Parameters(w_1=0.343).checked()
    assert [replace(Parameters(), grid=float(g)).area for g in (1, 2, 8)] == [1, 4, 64]
    df = spark.createDataFrame([(0.5, 0.3, 0.3, 0.4), (2.0, 0.3, 0.3, 0.4), (0.5, 0.3, 0.3, 0.5), (None, 0.3, 0.3, 0.4)], "beta double, w_1 double, w_2 double, w_3 double")
    assert [r.valid for r in valid_parameters(df).collect()] == [True, False, False, False]


def _golden(spark):
    """Five stations of a published two-month run, as rows for the fold: what its printed outputs imply."""
    land = [(1, 323.4, 0.42, (109.9769, 87.84986), (17.9233, 6.69117), (78.6928, 34.6474), (92.0536, 1.07564)), (2, 1455.8725, 0.58, (88.3097, 110.54202), (81.9193, 43.097), (241.108, 88.9861), (6.3904, 0.735501))]
    rows = []
    for cell, tsat, k, p, itp, eta, srn in land:
        for step in (1, 2):
            dense = 10 * tsat
            rows.append((cell, step, tsat, 0.1 * tsat, 0.5 * tsat, k, dense / tsat / 10, tsat, p[step - 1], itp[step - 1], 0.0, eta[step - 1], 1.0, 0.0, 0.0, srn[step - 1] / (p[step - 1] - itp[step - 1])))
    names = "cell_id long, step int, tsat double, wp double, fc double, k_sat double, bulk_density double, rootzone_depth double, precipitation double, itp double, et_o double, et_i double, a_i double, a_o double, etp double, runoff_coef double"
    return spark.createDataFrame(rows, names).withColumns({"a_v": F.lit(0.0), "a_s": F.lit(0.0), "kc": F.lit(0.0), "kc_min": F.lit(0.0)})


def test_golden_identities(spark):
    out = {(r.cell_id, r.step): r for r in water_balance(_golden(spark), Parameters(alpha=4.5)).collect()}
    for cell, k, srn1, smc1, bfw1, lfw2 in ((1, 0.42, 92.0536, 244.287, 0.143282, 0.119823), (2, 0.58, 6.3904, 1214.18, 0.174759, 0.201707)):
        a, b = out[cell, 1], out[cell, 2]
        assert a.lfw == pytest.approx(0.5 * k, rel=1e-6) and a.rec == a.lfw
        assert a.srn == pytest.approx(srn1, rel=1e-5)
        assert a.smc == pytest.approx(smc1, rel=1e-5)
        assert a.bfw == pytest.approx(bfw1, rel=1e-5)
        assert b.lfw == pytest.approx(lfw2, rel=2e-5)
        assert b.bfw == pytest.approx(a.bfw * math.exp(-0.5) + (1 - math.exp(-0.5)) * b.rec, rel=1e-9)
        assert a.rnf == pytest.approx(a.srn + a.lfw + a.bfw)


def _rows(spark, sf_dir):
    cells = testgrid.cells(spark, sf_dir).where("cell_id < 300").withColumn("slope", F.lit(0.1))
    forcing = testgrid.forcing(spark, sf_dir).where("cell_id < 300")
    return state_free(basin.cell_months(cells, forcing, testgrid.soil_attr(spark), testgrid.landuse_attr(spark), testgrid.months(spark)), testgrid.PARAMS)


def test_fold_properties(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    p = testgrid.PARAMS
    whole = {(r.cell_id, r.step): r for r in water_balance(rows, p).collect()}
    half = water_balance(rows.where("step <= 5"), p)
    again = water_balance(rows.where("step > 5"), p, last_state(half)).collect()
    for r in again:
        assert all(r[k] == pytest.approx(whole[r.cell_id, r.step][k], rel=1e-12, abs=1e-12) for k in ("smc", "sat", "bfw", "srn", "eta"))
    facts = {(r.cell_id, r.step): r for r in rows.select("cell_id", "step", "precipitation", "tsat", "a_o").collect()}
    for (cell, step), r in whole.items():
        f = facts[cell, step]
        before = whole[cell, step - 1].smc if step > 1 else f.tsat
        after = before + f.precipitation - r.itp - r.srn - r.lfw - r.rec - r.eta
        if f.a_o != 1 and 0 < after < f.tsat:
            assert r.smc == pytest.approx(after, rel=1e-9)
        assert 0 <= r.smc <= f.tsat


def test_null_month_ends_a_cell(spark, sf_dir):
    rows = _rows(spark, sf_dir).where("cell_id in (1, 2)").withColumn("itp", F.when((F.col("cell_id") == 1) & (F.col("step") == 3), None).otherwise(F.col("itp")))
    out = {(r.cell_id, r.step): r.smc for r in water_balance(rows, testgrid.PARAMS).collect()}
    assert out[1, 2] is not None and all(out[1, k] is None for k in range(3, 13)) and out[2, 12] is not None


def test_accumulation(spark):
    drain = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, None), (4, 2), (5, 4), (6, None)], "cell_id long, down_id long")
    flux = spark.createDataFrame([(c, 1, float(c + 1)) for c in range(7)], "cell_id long, step int, value double")
    got = {r.cell_id: r.value for r in network.accumulate(drain, flux).collect()}
    assert got == {0: 1, 1: 3, 2: 17, 3: 21, 4: 11, 5: 6, 6: 7}
    holed = flux.withColumn("value", F.when(F.col("cell_id") != 5, F.col("value")))
    got = {r.cell_id: r.value for r in network.accumulate(drain, holed).collect()}
    assert got == {0: 1, 1: 3, 2: None, 3: None, 4: None, 5: None, 6: 7}
    gauges = spark.createDataFrame([(2, 20), (3, 30), (6, 60)], "cell_id long, station_id int")
    cells, tree = network.gauge_catchments(drain, gauges)
    assert {(r.cell_id, r.gauge) for r in cells.collect()} == {(c, 2) for c in (0, 1, 2, 4, 5)} | {(3, 3), (6, 6)}
    assert {(r.cell_id, r.down_id) for r in tree.collect()} == {(2, 3), (3, None), (6, None)}
    at = {r.station_id: r.value for r in network.accumulate_at_gauges(drain, gauges, flux).collect()}
    assert at == {20: 17, 30: 21, 60: 7}
    with pytest.raises(ValueError, match="cycle"):
        network.jump_table(spark.createDataFrame([(0, 1), (1, 0)], "cell_id long, down_id long"))


def test_accumulation_over_blocks(spark, monkeypatch):
    """A random forest whose rivers cross small blocks again and again, against a walk down from each cell."""
    monkeypatch.setattr(network, "BLOCK", 16)
    r = random.Random(3)
    ids = list(range(300))
    r.shuffle(ids)
    down = {c: (ids[r.randrange(max(0, k - 6), k)] if k and r.random() > 0.02 else None) for k, c in enumerate(ids)}
    flux = {(c, s): (None if (c, s) == (ids[250], 2) else float(r.randrange(9))) for c in ids for s in (1, 2)}
    drain = spark.createDataFrame(list(down.items()), "cell_id long, down_id long")
    gauge = {c: k for k, c in enumerate(r.sample(ids, 12))}
    want, holes = {}, set()
    for (c, s), v in flux.items():
        at = c
        while at is not None:
            want[at, s] = want.get((at, s), 0.0) + (v or 0.0)
            holes |= {(at, s)} if v is None else set()
            at = down[at]
    want = {k: None if k in holes else v for k, v in want.items()}
    df = spark.createDataFrame([(c, s, v, c * 10) for (c, s), v in flux.items()], "cell_id long, step int, value double, other long")
    assert {(x.cell_id, x.step): x.value for x in network.accumulate(drain, df).collect()} == want
    carried = network.accumulate(drain, df, carry=("other",)).collect()
    assert {(x.cell_id, x.step): x.value for x in carried} == want and all(x.other == 10 * x.cell_id for x in carried)
    with monkeypatch.context() as m:  # three levels of blocks of two
        m.setattr(network, "TOP", 5)
        m.setattr(network, "UP", 2)
        assert {(x.cell_id, x.step): x.value for x in network.accumulate(drain, df).collect()} == want
    gauges = spark.createDataFrame(list(gauge.items()), "cell_id long, station_id int")
    assert {(x.station_id, x.step): x.value for x in network.accumulate_at_gauges(drain, gauges, df).collect()} == {(k, s): want[c, s] for c, k in gauge.items() for s in (1, 2)}
    assert network.accumulate(drain, df.where("false")).count() == 0
    loop = spark.createDataFrame([(1, 20), (20, 40), (40, 1)], "cell_id long, down_id long")
    with pytest.raises(Exception, match="cycle"):
        network.accumulate(loop, df.where("cell_id < 5")).collect()


def test_depressions_over_tiles(spark):
    """A rough surface of several tiles against one flood over all of it."""
    r = random.Random(5)
    rows, cols = 70, 140
    z = {(i, j): round(r.random() * 50, 2) for i in range(rows) for j in range(cols)}
    out = {}
    heap = [(v, k) for k, v in z.items() if k[0] in (0, rows - 1) or k[1] in (0, cols - 1)]
    heapq.heapify(heap)
    while heap:
        level, (i, j) = heapq.heappop(heap)
        if (i, j) not in out:
            out[i, j] = level
            for n in ((i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if n in z and n not in out:
                    heapq.heappush(heap, (max(level, z[n]), n))
    cells = spark.createDataFrame([(i * cols + j, i, j, v) for (i, j), v in z.items()], "cell_id long, row int, col int, dem double")
    want = {i * cols + j: v for (i, j), v in out.items()}
    assert {x.cell_id: x.filled for x in terrain.fill_depressions(cells).collect()} == want
    assert {x.cell_id: x.filled for x in terrain.fill_depressions(cells, tile=16, up=2, top=100).collect()} == want  # levels of groups


def test_depressions_of_a_winding_valley(spark):
    """One ditch through fifty tiles, dug into high ground with an unknown cell and a pit, has its only way out at its end."""
    side, cells = 64 * 7 + 2, {}
    for i in range(0, side, 64):
        for j in range(1, side - 1):
            cells[i + 1, j] = 5.0 + (i * side + (j if i % 128 == 0 else side - j)) * -1e-5
        end = side - 2 if i % 128 == 0 else 1
        for k in range(i + 1, min(i + 65, side - 1)):
            cells[k, end] = 5.0 - (i + 1) * side * 1e-5
    rows = [(i * side + j, i, j, cells.get((i, j), 30.0)) for i in range(side) for j in range(side)]
    rows[3 * side + 3] = (3 * side + 3, 3, 3, None)
    rows[200 * side + 200] = (200 * side + 200, 200, 200, 2.0)
    z = {(i, j): v for _, i, j, v in rows}
    out, heap = {}, [(v, k) for k, v in z.items() if k[0] in (0, side - 1) or k[1] in (0, side - 1)]
    heapq.heapify(heap)
    while heap:
        level, (i, j) = heapq.heappop(heap)
        if (i, j) not in out:
            out[i, j] = level
            for n in ((i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if z.get(n) is not None and n not in out:
                    heapq.heappush(heap, (max(level, z[n]), n))
    df = spark.createDataFrame(rows, "cell_id long, row int, col int, dem double")
    got = {x.cell_id: x.filled for x in terrain.fill_depressions(df).collect()}
    assert len(got) == side * side and got[3 * side + 3] is None
    assert all(got[i * side + j] == v for (i, j), v in out.items())


def shuffles(df):
    """Exchanges that move rows, in the plan that runs."""
    df.write.format("noop").mode("overwrite").save()
    text = df._jdf.queryExecution().executedPlan().toString()
    text = text.split("== Initial Plan ==")[0]
    return [line for line in text.splitlines() if "Exchange" in line and "Broadcast" not in line and "Reused" not in line]


def test_a_stored_basin_is_not_shuffled(spark, sf_dir):
    stored = testgrid.stored(spark, sf_dir)
    classes = (testgrid.soil_attr(spark), testgrid.landuse_attr(spark), testgrid.months(spark))
    one = fold_basin(stored, *classes, [testgrid.PARAMS])
    many = fold_basin(stored, *classes, [replace(testgrid.PARAMS, beta=0.3 + k / 100) for k in range(30)], "param_id")
    columns = water_balance(state_free(basin.stored_months(stored, *classes), testgrid.PARAMS), testgrid.PARAMS)
    assert shuffles(one) == [] and shuffles(many) == [] and shuffles(columns) == []
    assert many.count() == 30 * one.count()
    by_columns = {(r.cell_id, r.step): r for r in columns.where("cell_id < 100").collect()}
    for r in one.where("cell_id < 100").collect():
        assert all(r[c] == pytest.approx(by_columns[r.cell_id, r.step][c], rel=1e-9, abs=1e-9) for c in ("itp", "eta", "srn", "lfw", "rec", "bfw", "smc", "sat", "rnf"))


def test_runs_of_parameter_sets_are_routed(spark, sf_dir):
    """The discharge of each set equals that of a run with it alone, also from a state."""
    stored = testgrid.stored(spark, sf_dir)
    classes = (testgrid.soil_attr(spark), testgrid.landuse_attr(spark), testgrid.months(spark))
    sets = [testgrid.PARAMS, replace(testgrid.PARAMS, beta=0.8, x=0.2, t_ini=0.6)]
    many = {(r.param_id, r.cell_id, r.step): r.arn for r in basin.run_stored(stored, *classes, sets).collect()}
    for k, p in enumerate(sets, 1):
        one = {(r.cell_id, r.step): r.arn for r in basin.run_stored(stored, *classes, p).collect()}
        assert len(one) * 2 == len(many) and all(many[k, *key] == pytest.approx(v, rel=1e-12) for key, v in one.items())
    with pytest.raises(ValueError, match="one parameter set"):
        basin.run_stored(stored, *classes, sets, stored)
    with pytest.raises(ValueError, match="need a key"):
        fold_basin(stored, *classes, sets)


def test_basins_stay_where_a_path_is_given(spark, sf_dir, tmp_path):
    cells = testgrid.cells(spark, sf_dir).where("cell_id < 200").withColumn("slope", F.lit(0.1))
    kept = basin.store_basin(cells, testgrid.forcing(spark, sf_dir), buckets=3, path=str(tmp_path / "basin"))
    again = storage.opened(spark, str(tmp_path / "basin"), "block", 3)
    assert again.count() == kept.count() == 200 * 12 and shuffles(again.groupBy("block").count()) == []


def test_a_basin_is_written_in_passes(spark, sf_dir, tmp_path):
    """Where buckets are many, no shuffle holds the whole table; each bucket has one file, and the table is that of one pass."""
    cells = testgrid.cells(spark, sf_dir).withColumn("slope", F.lit(0.1))
    forcing = testgrid.forcing(spark, sf_dir, by_cell=True)
    one, many = (basin.store_basin(cells, forcing, buckets=n, path=str(tmp_path / f"basin{n}")) for n in (3, 40))
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty() and one.count() == 1500 * 12
    read = spark.read.parquet(str(tmp_path / "basin40"))
    assert read.select("block", F.col("_metadata.file_name").alias("f")).distinct().count() == read.select("block").distinct().count()
    before = {k: spark.conf.get(k) for k in storage.WRITING}
    with storage.writing(spark):
        plan = forcing.join(cells.select("cell_id"), "cell_id")._jdf.queryExecution().executedPlan().toString()
        assert not any("step" in x.split(")")[0] for x in plan.split("hashpartitioning(")[1:])
    assert {k: spark.conf.get(k) for k in storage.WRITING} == before


def test_a_run_stores_no_terms(spark, sf_dir, monkeypatch):
    """The terms of a run aren't written on the way, and a run from maps completes them in one scan."""
    wrote = []
    put = storage.checkpointed
    monkeypatch.setattr(network, "checkpointed", lambda df: wrote.append(df.columns) or put(df))
    monkeypatch.setattr(basin, "bucketed", lambda df, *a, **k: wrote.append(df.columns) or storage.bucketed(df, *a, **k))
    stored = testgrid.stored(spark, sf_dir)
    out = basin.run_stored(stored, testgrid.soil_attr(spark), testgrid.landuse_attr(spark), testgrid.months(spark), testgrid.PARAMS)
    assert out.count() == 1500 * 12 and wrote and not any("itp" in c for c in wrote)
    maps = testgrid.series(testgrid.forcing(spark, sf_dir)).where("not (series = 'ndvi' and step in (2, 3)) and cell_id < 300")
    scans = basin.complete_forcing(maps, 1, 4)
    assert scans._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey") == 1
    got = {(r.cell_id, r.step): r.ndvi for r in scans.collect()}
    given = {(r.cell_id, r.step): r.ndvi for r in testgrid.forcing(spark, sf_dir).where("cell_id < 300").collect()}
    assert len(got) == 1200 and all(v == given[c, 1 if s in (2, 3) else s] for (c, s), v in got.items())


def test_parameter_sets_are_runs_of_their_own(spark, sf_dir):
    cells = testgrid.cells(spark, sf_dir).where("cell_id < 40").withColumn("slope", F.lit(0.1))
    months = basin.cell_months(cells, testgrid.forcing(spark, sf_dir), testgrid.soil_attr(spark), testgrid.landuse_attr(spark), testgrid.months(spark))
    sets = [{"beta": 0.4, "alpha": 2.0, "f": 0.2, "t_ini": 0.5}, {"beta": 0.7, "alpha": 5.0, "f": 0.9, "t_ini": 1.0}]
    p = ParameterColumns(testgrid.PARAMS, tuple(sets[0]))
    swept = {(r.param_id, r.cell_id, r.step): r for r in water_balance(state_free(calibrate.sweep(months, sets), p), p, by=("param_id",)).collect()}
    for k, s in enumerate(sets, 1):
        own = replace(testgrid.PARAMS, **s)
        for r in water_balance(state_free(months, own), own).collect():
            assert all(swept[k, r.cell_id, r.step][c] == pytest.approx(r[c], rel=1e-12) for c in ("smc", "rnf", "itp", "sat"))
    assert len(swept) == 2 * 40 * 12


def test_run_completes_and_checks_its_maps(spark, sf_dir, tmp_path):
    cells = testgrid.cells(spark, sf_dir).where("cell_id < 60")
    maps = testgrid.series(testgrid.forcing(spark, sf_dir).where("cell_id < 60"))
    with pytest.raises(ValueError, match=r"no map of kp for steps \[2\]"):
        basin.complete_forcing(maps.where("not (series = 'kp' and step = 2)"), 1, 3)
    tables_ = (testgrid.soil_attr(spark), testgrid.landuse_attr(spark), testgrid.months(spark))
    with pytest.raises(ValueError, match="no output"):
        basin.run(cells, maps, *tables_, testgrid.PARAMS, 1, 3, Outputs(*[False] * 9))
    chosen = Outputs(itp=False, bfw=False, srn=False, eta=False, lfw=False, rec=False, smc=False)
    assert chosen.any() and not chosen.all() and Outputs().all() and chosen.enabled() == ("rnf", "arn")
    out = basin.run(cells, maps, *tables_, testgrid.PARAMS, 2, 4, chosen, str(tmp_path / "out"), [5])
    assert out.columns == ["cell_id", "step", "rnf", "arn"] and {r.step for r in out.select("step").distinct().collect()} == {2, 3, 4}
    assert spark.read.parquet(str(tmp_path / "out/maps")).count() == 2 * 3 * 60 and (tmp_path / "out/stations/variable=arn").exists()
    given = cells.withColumn("ldd", F.lit(6))
    edges = {r.cell_id: r.down_id for r in basin.drainage(given).collect()}
    assert edges[0] == 1 and edges[59] is None


def test_smoothing_and_accumulation_commute(spark):
    drain = spark.createDataFrame([(0, 1), (1, None), (2, 1)], "cell_id long, down_id long")
    flux = spark.createDataFrame([(c, s, float(c * 3 + s)) for c in range(3) for s in (1, 2, 3)], "cell_id long, step int, value double")
    a = network.accumulate(drain, network.recession_smooth(flux, 0.3).select("cell_id", "step", F.col("smooth").alias("value")))
    b = network.recession_smooth(network.accumulate(drain, flux), 0.3).select("cell_id", "step", F.col("smooth").alias("value"))
    one, two = ({(r.cell_id, r.step): r.value for r in x.collect()} for x in (a, b))
    assert one == {k: pytest.approx(v) for k, v in two.items()} and len(one) == 9


def test_smoothing_packed_months_shuffles_nothing(spark, sf_dir):
    """Runoff of a stored basin is smoothed and summed up where it lies, equal to smoothing rows."""
    stored = testgrid.stored(spark, sf_dir)
    smooth = QUERIES["recession_smooth"](spark, sf_dir)
    assert not any("hashpartitioning" in x for x in shuffles(smooth))  # the calendar alone comes together
    rows = fold_basin(stored, testgrid.soil_attr(spark), testgrid.landuse_attr(spark), testgrid.months(spark), [testgrid.PARAMS]).where("cell_id < 50").join(testgrid.months(spark), "step")
    flow = rows.select("cell_id", "step", (F.col("rnf") * testgrid.PARAMS.area * 0.001 / (F.col("days_in_month") * 86400)).alias("value"))
    want = {(r.cell_id, r.step): r.smooth for r in network.recession_smooth(flow, testgrid.PARAMS.x).collect()}
    got = {(r.cell_id, r.step): r.smooth for r in smooth.where("cell_id < 50").collect()}
    assert got == {k: pytest.approx(v, abs=1e-8) for k, v in want.items()} and len(got) == 600
    discharge = QUERIES["cell_discharge"](spark, sf_dir)
    assert len(shuffles(discharge)) == 1 and "SortMergeJoin" not in discharge._jdf.queryExecution().sparkPlan().toString()  # sums by month alone move, not the terms to the calendar
    plan = discharge._jdf.queryExecution().analyzed().toString()
    assert "runoff_coef" not in plan  # no monthly terms as columns, which a sort by cells would carry


def test_terrain(spark):
    grid = [[9.0, 9.0, 9.0, 9.0], [9.0, 1.0, 5.0, 9.0], [9.0, 5.0, 5.0, 6.0], [9.0, 9.0, 9.0, 9.0]]
    cells = spark.createDataFrame([(r * 4 + c, r, c, z) for r, line in enumerate(grid) for c, z in enumerate(line)], "cell_id long, row int, col int, dem double")
    filled = {r.cell_id: r.filled for r in terrain.fill_depressions(cells).collect()}
    assert filled[5] == 6 and filled[6] == 6 and filled[10] == 6 and filled[11] == 6 and filled[0] == 9
    ldd = {r.cell_id: r.ldd for r in terrain.drain_direction(cells).collect()}
    assert ldd[5] == 5 and ldd[6] == 4 and ldd[10] == 7 and ldd[0] == 3
    edges = {r.cell_id: r.down_id for r in terrain.drain_edges(cells.join(terrain.drain_direction(cells), "cell_id")).collect()}
    assert edges[0] == 5 and edges[5] is None
    plane = spark.createDataFrame([(r * 5 + c, r, c, 2.0 * c + 1.0 * r) for r in range(5) for c in range(5)], "cell_id long, row int, col int, dem double")
    inner = {r.cell_id: r.slope for r in terrain.slope(plane, 10.0).collect()}
    assert inner[12] == pytest.approx(math.sqrt(0.2**2 + 0.1**2))


def test_validation_rules(spark):
    rows = [("precipitation", 1, 1, v) for v in (10.0, 50.0)] + [("ndvi", 1, 1, 1.5), ("kp", 1, 1, None), ("landuse", 1, 1, 0.0), ("landuse", 1, 2, 3.0), ("dem", 1, 1, 1.0), ("other", 1, 1, -5.0)]
    got = {(r.layer, r.band): r.violation for r in quality.validate_layers(spark.createDataFrame(rows, "layer string, step int, band int, value double")).collect()}
    assert got == {
        ("precipitation", 1): None, ("ndvi", 1): "FORBID_OUT_OF_RANGE", ("kp", 1): "FORBID_NO_DATA", ("landuse", 1): "FORBID_ALL_ZEROES",
        ("landuse", 2): None, ("dem", 1): "FORBID_ALL_ONES", ("other", 1): None,
    }


def test_class_tables(spark):
    bad = {r.landuse for r in lookup.check_landuse_table(testgrid.landuse_attr(spark)).collect()}
    assert bad == {0, 11, 18, 27, 31, 23, 24, 25, 29}
    a = spark.createDataFrame([(1, 0.5), (2, 0.6)], "code int, value double")
    b = spark.createDataFrame([(2, 7.0), (3, 8.0)], "code int, value double")
    assert {tuple(r) for r in lookup.wide_lookup({"x": a, "y": b}).collect()} == {(1, 0.5, None), (2, 0.6, 7.0), (3, None, 8.0)}


def test_series_names_and_gaps(spark):
    paths = spark.createDataFrame([("/m/NDVI0000.001",), ("/m/ndvi0001.012",), ("/m/ndvi001.001",), ("/m/x.tif",)], "path string")
    assert sorted(r.step for r in series.series_catalog(paths, "ndvi").collect()) == [1, 1012]
    with pytest.raises(ValueError):
        series.series_catalog(paths, "longprefix")
    with pytest.raises(ValueError):
        series.series_catalog(paths, "kc")
    steps = series.carry_forward_steps(spark.createDataFrame([(1,), (4,), (6,)], "step int"), 3, 7)
    assert {r.step: r.effective_step for r in steps.collect()} == {3: None, 4: 4, 5: 4, 6: 6, 7: 6}


def test_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("0 0.65\n3\t1.14\n\n  \n33;0.7\n")
    got = {r.code: r.value for r in tables.read_lookup(spark, str(tmp_path / "t.txt")).collect()}
    assert got == {0: 0.65, 3: 1.14, 33: 0.7}
    (tmp_path / "obs.csv").write_text("1.5;2.5;10;11\n3.5;4.5;20;21\n")
    obs = {(r.lon, r.step): r.value for r in tables.read_station_obs(spark, str(tmp_path / "obs.csv")).collect()}
    assert obs == {(1.5, 1): 10, (1.5, 2): 11, (3.5, 1): 20, (3.5, 2): 21}
    names = spark.range(1).select(tables.layer_name("itp", F.lit(1)), tables.layer_name("itp", F.lit(1), "8.3"), tables.layer_name("itp", F.lit(1234), "8.3")).first()
    assert tuple(names) == ("itp0000001.tif", "itp00000.001", "itp00001.234")
    outputs = spark.createDataFrame([(1, 1, 0.5, 2.0), (2, 1, 0.25, 3.0)], "cell_id long, step int, itp double, arn double")
    tables.write_series(outputs, str(tmp_path / "maps"), ("itp", "arn"))
    back = spark.read.parquet(str(tmp_path / "maps"))
    assert back.count() == 4 and dict(back.dtypes)["value"] == "float"
    samples = stations.sample_stations(outputs, spark.createDataFrame([(1, 7), (2, 3)], "cell_id long, station_id int"))
    tables.write_station_csv(samples, [7, 3], str(tmp_path / "tss"))
    lines = next((tmp_path / "tss" / "variable=arn").glob("*.csv")).read_text().splitlines()
    assert lines == ["0;3;7", "1;3.0;2.0"]


def test_many_stations_side_by_side(spark, tmp_path):
    """Plans don't grow with the stations, outputs aren't shuffled to meet them, and lines of any length come back."""
    at = spark.range(3000).select(F.col("id").alias("cell_id"), (F.col("id") * 2).cast("int").alias("station_id"))
    outputs = spark.range(3100).crossJoin(spark.range(1, 3).toDF("step")).select(F.col("id").alias("cell_id"), F.col("step").cast("int").alias("step"), F.when(F.col("id") % 7 != 0, F.col("id") * 1.5 + F.col("step")).alias("arn"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        samples = stations.sample_stations(outputs, at)
        assert shuffles(samples) == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    ids = [*range(0, 6000, 2), 6001]
    rows = stations.side_by_side(samples.where("station_id != 4 or step = 1"), ids)
    assert len(rows._jdf.queryExecution().optimizedPlan().toString()) < 10_000
    got = {(r.variable, r.step): r["values"] for r in rows.collect()}
    want = lambda k, s: None if k % 7 == 0 or k > 2999 or (k, s) == (2, 2) else k * 1.5 + s
    assert got == {("arn", s): [want(k, s) for k in range(3001)] for s in (1, 2)}
    tables.write_station_csv(samples, ids, str(tmp_path / "tss"))
    back = {(r.variable, r.step, r.station_id): r.value for r in tables.read_station_csv(spark, str(tmp_path / "tss")).collect()}
    assert len(back) == 2 * 3001 and all(v == (None if s == 6001 or s // 2 % 7 == 0 else s // 2 * 1.5 + t) for (_, t, s), v in back.items())


def test_windows_read_their_own_maps(spark, tmp_path):
    rows = [("p", s, c, float(c + s)) for s in range(1, 7) for c in range(50)]
    df = spark.createDataFrame(rows, "series string, step int, cell_id long, value double")
    tables.write_partitioned_series(df, str(tmp_path / "series"))
    window = calendar.clip_period(tables.read_series(spark, str(tmp_path / "series")), 2, 3)
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "step" in plan.split("PartitionFilters: [")[1].split("]")[0] and window.count() == 100
    tables.write_named_maps(df.select("step", "cell_id", "value"), str(tmp_path / "maps"), "Rain")
    read = tables.read_named_maps(spark, str(tmp_path / "maps"), "rAIN", 4, 5)
    assert sorted((r.step, r.cell_id, r.value) for r in read.collect()) == [(s, c, v) for _, s, c, v in rows if s in (4, 5)] and len(read.inputFiles()) < 2 * 6
    assert {f.split("/")[-2] for f in read.inputFiles()} == {"Rain0000.004", "Rain0000.005"}
    for bad in ({"prefix": "toolongname"}, {"prefix": "kc"}, {"prefix": "rain", "first": 9}):
        with pytest.raises(ValueError):
            tables.read_named_maps(spark, str(tmp_path / "maps"), **bad)
    outputs = spark.range(4000).select(F.col("id").alias("cell_id"), F.lit(1).alias("step"), F.lit(0.5).alias("itp"), F.lit(1.5).alias("arn"))
    tables.write_series(outputs, str(tmp_path / "large"), ("itp", "arn"), parts=8)
    assert all(len(list((tmp_path / f"large/variable={v}/step=1").glob("*.parquet"))) > 1 for v in ("itp", "arn"))


def test_maps_are_written_where_their_cells_lie(spark, tmp_path):
    """Each task writes its part of every map, in order of the cells, whose ids are stored as differences."""
    outputs = spark.range(3000, numPartitions=3).select((F.col("id") * 7 % 3000).alias("cell_id"), F.lit(1).alias("step"), (F.col("id") / 8).alias("itp"), F.lit(1.5).alias("arn"))
    tables.write_series(outputs, str(tmp_path / "maps"), ("itp", "arn"), parts=8)
    for v in ("itp", "arn"):
        files = [pq.ParquetFile(f) for f in (tmp_path / f"maps/variable={v}/step=1").glob("*.parquet")]
        assert sorted(f.metadata.num_rows for f in files) == [1000] * 3
        for f in files:
            ids = f.read(["cell_id"]).column(0).to_pylist()
            assert ids == sorted(ids) and "DELTA_BINARY_PACKED" in f.metadata.row_group(0).column(0).encodings
    back = spark.read.parquet(str(tmp_path / "maps"))
    assert {(r.variable, r.cell_id): r.value for r in back.collect()} == {(v, k * 7 % 3000): (k / 8 if v == "itp" else 1.5) for v in ("itp", "arn") for k in range(3000)}


def test_kriging(spark):
    rows = [(k, float(k % 4), float(k // 4), s, float((k * 7 + s) % 5 + 1) if s < 3 else 4.0) for k in range(12) for s in (1, 2, 3)]
    obs = spark.createDataFrame(rows, "station_id long, lon double, lat double, step int, value double")
    at = obs.select(F.col("station_id").alias("cell_id"), "lon", "lat").distinct()
    got = {(r.cell_id, r.step): r.value for r in interpolate.krige(obs, at, nugget=0.0).collect()}
    for k, _, _, s, v in rows:
        assert got[k, s] == pytest.approx(v, abs=1e-6)
    for r in interpolate.solve_kriging(obs).collect():
        assert not r.dual or sum(r.dual) == pytest.approx(0, abs=1e-9)
    with pytest.raises(Exception, match="fewer than 3"):
        interpolate.krige(obs.where("station_id < 2"), at)


def test_kriging_from_the_nearest_stations(spark):
    """From all stations it is global kriging; from some it is a system of the nearest ones for each cell, solved one by one."""
    r = random.Random(8)
    rows = [(k, r.random() * 4, r.random() * 3, s, round(r.random() * 9, 3) if (k + s) % 7 else None) for k in range(40) for s in (1, 2)]
    obs = spark.createDataFrame(rows, "station_id long, lon double, lat double, step int, value double")
    spots = {k: (x, y) for k, x, y, _, _ in rows}
    obs = spark.createDataFrame([(k, *spots[k], s, v) for k, _, _, s, v in rows], obs.schema)
    places = [(c, r.random() * 4 - 0.2, r.random() * 3) for c in range(60)]
    cells = spark.createDataFrame(places, "cell_id long, lon double, lat double")
    for geographic in (False, True):
        whole = {(x.cell_id, x.step): x.value for x in interpolate.krige(obs, cells, geographic=geographic).collect()}
        same = {(x.cell_id, x.step): x.value for x in interpolate.krige(obs, cells, geographic=geographic, nearest=1000).collect()}
        assert len(whole) == 120 and same == {k: pytest.approx(v, abs=1e-8) for k, v in whole.items()}
    models = {x.step: x for x in interpolate.variogram_models(obs, geographic=False).collect()}
    some = {(x.cell_id, x.step): x.value for x in interpolate.krige_nearest(obs, cells, 6, geographic=False, tile=0.7).collect()}
    for c, x, y in places:
        for step in (1, 2):
            near = sorted((math.dist((x, y), spots[k]), k, v) for k, _, _, s, v in rows if s == step and v is not None)[:6]
            gamma = lambda d, m=models[step]: 0.0 if d == 0 else m.nugget + m.sill * (1.5 * min(d / m.span, 1) - 0.5 * min(d / m.span, 1) ** 3)
            m = np.array([[gamma(math.dist(spots[a], spots[b])) for _, b, _ in near] + [1.0] for _, a, _ in near] + [[1.0] * 6 + [0.0]])
            weight = np.linalg.solve(m, [gamma(d) for d, _, _ in near] + [1.0])
            assert some[c, step] == pytest.approx(max(0.0, sum(w * v for w, (_, _, v) in zip(weight, near, strict=False))), abs=1e-7)
    with pytest.raises(ValueError, match="fewer than 3"):
        interpolate.krige(obs.where("station_id < 2"), cells, nearest=5)


def test_semivariogram_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(interpolate, "BLOCK", 7)
    r = random.Random(2)
    rows = [(k, float(r.randrange(9)), r.random(), s, r.random() if r.random() > 0.2 else None) for k in range(30) for s in (1, 2, 3)]
    spots = {k: (x, y) for k, x, y, _, _ in rows}
    obs = spark.createDataFrame([(k, *spots[k], s, v) for k, _, _, s, v in rows], "station_id long, lon double, lat double, step int, value double")
    got = {(x.step, x.lag): (x.distance, x.gamma, x.n) for x in interpolate.semivariogram(obs, 5, geographic=False).collect()}
    want = {}
    for step in (1, 2, 3):
        here = [(k, v) for k, _, _, s, v in rows if s == step and v is not None]
        pairs = [(math.dist(spots[a], spots[b]), (v - w) ** 2 / 2) for i, (a, v) in enumerate(here) for b, w in here[i + 1 :]]
        most = max(d for d, _ in pairs)
        for d, g in pairs:
            want.setdefault((step, min(5, max(1, math.ceil(d / most * 5)))), []).append((d, g))
    assert got == {k: (pytest.approx(sum(d for d, _ in x) / len(x)), pytest.approx(sum(g for _, g in x) / len(x)), len(x)) for k, x in want.items()}


def test_many_stations_at_few_places(spark, monkeypatch):
    """However many stations lie at a place, only places meet, and kriging is the least-squares solution of the system of all stations."""
    r = random.Random(5)
    rows = [(k, float(k % 3), float(k // 3 % 4), s, float(r.randrange(50)) if r.random() > 0.1 else None) for k in range(60) for s in (1, 2)]
    obs = spark.createDataFrame(rows, "station_id long, lon double, lat double, step int, value double")
    seen = []
    monkeypatch.setattr(interpolate, "checkpointed", lambda df: seen.append(storage.checkpointed(df)) or seen[-1])
    lags = {(x.step, x.lag): (x.distance, x.gamma, x.n) for x in interpolate.semivariogram(obs, 4, geographic=False).collect()}
    assert [x.count() for x in seen] == [12]
    cells = spark.createDataFrame([(c, r.random() * 3, r.random() * 4) for c in range(20)], "cell_id long, lon double, lat double")
    solved = {x.step: x for x in interpolate.solve_kriging(obs, geographic=False).collect()}
    whole, near = ({(x.cell_id, x.step): x.value for x in interpolate.krige(obs, cells, geographic=False, nearest=n).collect()} for n in (None, 7))
    del seen[:]
    interpolate.krige_nearest(obs, cells, 3, geographic=False)
    assert [x.count() for x in seen if "station_id" in x.columns][-1] < 60
    for step in (1, 2):
        here = [(k, x, y, v) for k, x, y, s, v in rows if s == step and v is not None]
        pairs = [(math.dist(a[1:3], b[1:3]), (a[3] - b[3]) ** 2 / 2) for i, a in enumerate(here) for b in here[i + 1 :]]
        most = max(d for d, _ in pairs)
        for lag in range(1, 5):
            own = [(d, g) for d, g in pairs if max(1, math.ceil(d / most * 4)) == lag]
            assert lags[step, lag] == (pytest.approx(sum(d for d, _ in own) / len(own)), pytest.approx(sum(g for _, g in own) / len(own)), len(own))
        m = solved[step]
        gamma = lambda d, m=m: 0.0 if d == 0 else m.nugget + m.sill * (1.5 * min(d / m.span, 1) - 0.5 * min(d / m.span, 1) ** 3)
        for c in cells.collect():
            for got, chosen in ((whole, here), (near, sorted(here, key=lambda t, c=c: (math.dist((c.lon, c.lat), t[1:3]), t[0]))[:7])):
                system = np.array([[gamma(math.dist(a[1:3], b[1:3])) for b in chosen] + [1.0] for a in chosen] + [[1.0] * len(chosen) + [0.0]])
                dual = np.linalg.lstsq(system, np.array([v for *_, v in chosen] + [0.0]), rcond=1e-10)[0]
                want = sum(gamma(math.dist((c.lon, c.lat), a[1:3])) * u for a, u in zip(chosen, dual, strict=False)) + dual[-1]
                assert got[c.cell_id, step] == pytest.approx(max(0.0, want), abs=1e-6)


def test_fit(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.5), ("a", 4.0, 3.5), ("a", None, 1.0), ("b", 1.0, 3.0), ("b", 1.0, 1.0)], "k string, observed double, simulated double")
    got = {r.k: r for r in calibrate.goodness_of_fit(df, ("k",)).collect()}
    assert got["a"].n == 3 and got["a"].rmse == pytest.approx(math.sqrt(0.5 / 3)) and got["a"].mean_error == pytest.approx(0)
    assert got["a"].nse == pytest.approx(1 - 0.5 / (14 / 3)) and got["b"].nse is None


def test_report_of_a_run_is_that_of_its_inputs(spark):
    cells = spark.createDataFrame([(k, 100.0 + k, 1 + k % 2, 0.1, None if k == 3 else 0.8, 1.0) for k in range(6)], "cell_id long, dem double, soil int, ndvi_min double, ndvi_max double, slope double")
    forcing = spark.createDataFrame(
        [(k, s, -1.0 if (k, s) == (2, 2) else 50.0, 40.0, None if s == 3 else 0.7, 1.5 if s == 1 else 0.4, 0 if s == 2 else 77) for k in range(6) for s in (1, 2, 3)],
        "cell_id long, step int, precipitation double, etp double, kp double, ndvi double, landuse int",
    )
    args = (testgrid.soil_attr(spark), testgrid.landuse_attr(spark))
    kept = basin.store_basin(cells, forcing)
    seen, watch = quality.watched(kept, *args)
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("watched"))
    spark.sparkContext.setJobGroup("watched", "")
    plan = fold_basin(seen, *args, testgrid.months(spark), [testgrid.PARAMS])
    before = jobs()
    plan.write.format("noop").mode("overwrite").save()
    ran = jobs() - before
    got = {tuple(r) for r in quality.watched_report(spark, watch, args[1], testgrid.PARAMS).collect()}
    plain = fold_basin(kept, *args, testgrid.months(spark), [testgrid.PARAMS])
    before = jobs()
    plain.write.format("noop").mode("overwrite").save()
    assert ran == jobs() - before  # watching adds no job
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {tuple(r) for r in quality.input_report(cells, forcing, *args, testgrid.PARAMS).collect()}
    assert {("map rule", "FORBID_OUT_OF_RANGE", "ndvi step 1", True), ("map rule", "FORBID_NO_DATA", "kp step 3", True), ("map rule", "FORBID_ALL_ZEROES", "landuse step 2", True), ("class without a row", "77", "landuse", True), ("map rule", "FORBID_NO_DATA", "ndvi_max step 0", True)} <= got


def test_an_empty_basin_breaks_no_rule(spark):
    kind = "block int, cell_id long, step int, dem double, soil int, ndvi_min double, ndvi_max double, precipitation double, etp double, kp double, ndvi double, landuse int"
    seen, watch = quality.watched(spark.createDataFrame([], kind), testgrid.soil_attr(spark), testgrid.landuse_attr(spark))
    assert seen.collect() == []
    assert {r.description for r in quality.watched_report(spark, watch, testgrid.landuse_attr(spark), testgrid.PARAMS, ()).collect()} <= {"class table rule", "output"}


def test_domain_errors_are_where_strict_raises(spark):
    values = [(k, n, p, d) for k, (n, p, d) in enumerate([(1.0, 5.0, 2.0), (0.5, 5.0, 0.0), (None, 5.0, 2.0), (1.0, None, 0.0), (0.2, 0.0, 3.0)])]
    rows = spark.createDataFrame(values, "k int, n double, p double, d double")
    terms = lambda strict: {"ratio": (vegetation.simple_ratio("n", strict), ("n",)), "rain": (runoff.rain_per_rainy_day("p", "d", strict), ("p", "d"))}
    got = {(r.k, r.term) for r in quality.domain_errors(rows, terms(False), ("k",)).collect()}
    raised = set()
    for k, *_ in values:
        for name, (c, _) in terms(True).items():
            try:
                rows.where(f"k = {k}").select(c).collect()
            except Exception as e:  # noqa: BLE001
                assert "is 0" in str(e)
                raised.add((k, name))
    assert got == raised == {(0, "ratio"), (3, "ratio"), (1, "rain")}  # where an operand is NULL nothing raises
