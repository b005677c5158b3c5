"""Registered queries that write tables to files in the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import lookup, stations
from ..operators.calendar import clip_period
from ..operators.storage import new_path
from ..schema import CELLS, OUTPUTS, SERIES
from ..sources import tables
from . import testgrid
from .queries import STATION_SQL, _outputs, _r, _samples, _station_ids, query


def _folder(spark: SparkSession) -> str:
    """A folder that goes when the application ends; results read it until then."""
    return new_path(spark, "files")


ATTRIBUTES = ("manning", "a_v", "a_o", "a_s", "a_i", "kc_min", "kc_max")


@query(f"SELECT landuse, {', '.join(ATTRIBUTES)} FROM landuse_attr WHERE landuse IN (SELECT landuse FROM forcing)", "landuse_attr", "forcing")
def class_table_files(spark, sf_dir):
    """One file of lines a class attribute, as class tables arrive, merged to a wide table of the classes in use."""
    folder, wide = _folder(spark), testgrid.landuse_attr(spark)
    for name in ATTRIBUTES:
        wide.select(F.concat(F.lit("  "), F.col("landuse").cast("string"), F.lit(" \t "), F.col(name).cast("string"), F.lit("\n"))).write.text(f"{folder}/{name}")
    merged = lookup.wide_lookup({name: tables.read_lookup(spark, f"{folder}/{name}") for name in ATTRIBUTES}).withColumnRenamed("code", "landuse")
    return merged.join(testgrid.forcing(spark, sf_dir).select("landuse").distinct(), "landuse", "left_semi")


@query("SELECT kind, cell_id, r AS \"row\", c AS col, round(dem, 6) AS dem, soil, round(ndvi_min, 6) AS ndvi_min, round(ndvi_max, 6) AS ndvi_max, station_id, mask FROM cells CROSS JOIN (VALUES ('csv'), ('parquet')) AS k(kind)", "cells")
def cell_files(spark, sf_dir):
    folder = _folder(spark)
    names = [c.split()[0] for c in CELLS.split(", ")]
    cells = testgrid.cells(spark, sf_dir).withColumn("ldd", F.lit(None).cast("int")).select(*names)
    cells.write.parquet(f"{folder}/parquet")
    cells.write.csv(f"{folder}/csv", header=True)
    both = [tables.read_cells(spark, f"{folder}/{k}", k).withColumn("kind", F.lit(k)) for k in ("parquet", "csv")]
    rounded = {c: _r(F.col(c), 6) for c in ("dem", "ndvi_min", "ndvi_max")}
    return both[0].unionByName(both[1]).withColumns(rounded).drop("ldd")


@query("SELECT series, step, count(*) AS n, round(sum(value), 4) AS total FROM long GROUP BY series, step", "long")
def series_files(spark, sf_dir):
    folder = _folder(spark)
    names = [c.split()[0] for c in SERIES.split(", ")]
    testgrid.series(testgrid.forcing(spark, sf_dir)).select(*names).write.parquet(folder)
    return tables.read_series(spark, folder).groupBy("series", "step").agg(F.count("*").alias("n"), _r(F.sum("value")).alias("total"))


@query(
    "SELECT v.variable, step, count(*) AS n, round(avg(CASE v.variable " + " ".join(f"WHEN '{v}' THEN {v}" for v in OUTPUTS) + f" END::FLOAT::DOUBLE), 3) AS mean FROM balance JOIN arn USING (cell_id, step) CROSS JOIN (VALUES {', '.join(f"('{v}')" for v in OUTPUTS)}) AS v(variable) GROUP BY v.variable, step",
    "balance", "arn",
)
def map_files(spark, sf_dir):
    """All nine variables as float maps by variable and step, a map in several files."""
    folder = _folder(spark)
    tables.write_series(_outputs(spark, sf_dir), folder)
    return spark.read.parquet(folder).groupBy("variable", "step").agg(F.count("*").alias("n"), _r(F.avg(F.col("value").cast("double")), 3).alias("mean"))


@query("SELECT series, step, count(*) AS n, round(sum(value), 4) AS total FROM long WHERE series IN ('precipitation', 'ndvi') AND step BETWEEN 3 AND 9 GROUP BY series, step", "long")
def map_series_by_name(spark, sf_dir):
    """Monthly maps in files named prefix and step (8.3), found by their names; only those of the window are read."""
    folder, maps = _folder(spark), testgrid.series(testgrid.forcing(spark, sf_dir))
    prefixes = {"precipitation": "prec", "ndvi": "NDVI"}
    for name, prefix in prefixes.items():
        tables.write_named_maps(maps.where(F.col("series") == name).select("step", "cell_id", "value"), f"{folder}/{name}", prefix)
    read = [tables.read_named_maps(spark, f"{folder}/{name}", prefix.swapcase(), 3, 9).withColumn("series", F.lit(name)) for name, prefix in prefixes.items()]
    return read[0].unionByName(read[1]).groupBy("series", "step").agg(F.count("*").alias("n"), _r(F.sum("value")).alias("total"))


@query("SELECT series, step, count(*) AS n, round(sum(value), 4) AS total FROM long WHERE step BETWEEN 4 AND 6 GROUP BY series, step", "long")
def partitioned_series(spark, sf_dir):
    """A series table by series and step, of which a window reads its own folders only."""
    folder = _folder(spark)
    tables.write_partitioned_series(testgrid.series(testgrid.forcing(spark, sf_dir)), folder)
    return clip_period(tables.read_series(spark, folder), 4, 6).groupBy("series", "step").agg(F.count("*").alias("n"), _r(F.sum("value")).alias("total"))


@query(STATION_SQL, "balance", "arn", "cells")
def station_files(spark, sf_dir):
    """The stations' tables, read back from their files."""
    folder, ids = _folder(spark), _station_ids(spark, sf_dir)
    tables.write_station_csv(_samples(spark, sf_dir), ids, folder)
    return tables.read_station_csv(spark, folder)


@query("SELECT lon, lat, step, round(value::DOUBLE, 4) AS value FROM obs", "obs")
def station_obs_file(spark, sf_dir):
    """Records of stations in one line each, lon;lat;value of step 1;..."""
    folder = _folder(spark)
    wide = testgrid.station_obs(spark, sf_dir).groupBy("station_id", "lon", "lat").pivot("step", list(range(1, 13))).agg(F.first("value"))
    wide.drop("station_id").write.csv(folder, sep=";")
    read = tables.read_station_obs(spark, folder).where("value is not null")
    return read.select("lon", "lat", "step", _r(F.col("value")).alias("value"))
