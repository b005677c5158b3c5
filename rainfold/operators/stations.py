"""Series at stations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import OUTPUTS
from .small import small
from .storage import checkpointed


def stations_of(cells: DataFrame) -> DataFrame:
    """(cell_id, station_id) of the cells with a station."""
    return cells.where("station_id is not null").select("cell_id", "station_id")


def station_ids(cells: DataFrame) -> DataFrame:
    return stations_of(cells).select("station_id").distinct().orderBy("station_id")


def sample_stations(outputs: DataFrame, stations: DataFrame, variables: tuple[str, ...] = OUTPUTS) -> DataFrame:
    """(variable, step, station_id, value): the outputs at the station cells, long. Stations are few beside cells: up to a million are broadcast, so that outputs stay where they lie."""
    names = [v for v in variables if v in outputs.columns]
    there = outputs.join(small(stations, 1_000_000), "cell_id")
    return there.select("step", "station_id", F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("value")) for v in names])).alias("x")).select("x.variable", "step", "station_id", "x.value")


def side_by_side(samples: DataFrame, ids: list[int]) -> DataFrame:
    """(variable, step, values): a row a map with an array of the values at ``ids`` in ascending order, NULL where there is none; for any number of stations, as no plan grows with them."""
    spark, at, samples = samples.sparkSession, sorted(ids), checkpointed(samples)
    places = F.broadcast(spark.createDataFrame([(k,) for k in at], "station_id int"))
    known = samples.groupBy("variable", "step", "station_id").agg(F.first("value").alias("value")).join(places, "station_id")
    every = samples.select("variable", "step").distinct().crossJoin(places)
    full = every.join(known, ["variable", "step", "station_id"], "left").groupBy("variable", "step")
    rows = full.agg(F.array_sort(F.collect_list(F.struct("station_id", "value"))).alias("s"))
    return rows.select("variable", "step", F.transform("s", lambda x: x["value"]).alias("values"))


def station_report(samples: DataFrame, ids: list[int]) -> DataFrame:
    """(variable, step, one column a station): ids are given, so no extra job looks for them; both are in ascending order. Plans grow with the columns: thousands of stations go ``side_by_side``."""
    wide = samples.groupBy("variable", "step").pivot("station_id", sorted(ids)).agg(F.first("value"))
    return wide.orderBy("variable", "step")


def stack(outputs: DataFrame, variables: tuple[str, ...] = OUTPUTS) -> DataFrame:
    """(cell_id, step, variable, value): the enabled variables one below the other."""
    names = [v for v in variables if v in outputs.columns]
    return outputs.unpivot(["cell_id", "step"], names, "variable", "value")
