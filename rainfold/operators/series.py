"""Series of maps: catalogues, alignment, missing months, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def null_if_nodata(c: Column, nodata: float) -> Column:
    return F.nullif(c, F.lit(nodata).cast("double"))


def fill_nodata(c: Column, nodata: float) -> Column:
    return F.coalesce(c, F.lit(nodata))


SCALES = {"boolean": "boolean", "nominal": "int", "scalar": "double", "ldd": "int"}


def to_value_scale(c: Column, scale: str) -> Column:
    """Casts to a value scale; nominal values lose their fraction."""
    return c.cast(SCALES[scale])


def series_catalog(paths: DataFrame, prefix: str, column: str = "path") -> DataFrame:
    """(path, name, step) of the files of a series, whose names are the prefix, digits up to 8 characters, a dot and 3 digits.

    Case doesn't count. ValueError for a prefix of 8 characters or more, or where no file matches.
    """
    if len(prefix) >= 8:
        raise ValueError("a prefix has fewer than 8 characters")
    import re

    pattern = rf"(?i)^{re.escape(prefix)}([0-9]{{{8 - len(prefix)}}})\.([0-9]{{3}})$"
    name = F.substring_index(column, "/", -1)
    found = paths.select(F.col(column).alias("path"), name.alias("name")).where(F.col("name").rlike(pattern))
    if found.isEmpty():
        raise ValueError(f"no file of series {prefix}")
    digits = F.concat(F.regexp_extract("name", pattern, 1), F.regexp_extract("name", pattern, 2))
    return found.withColumn("step", digits.try_cast("int"))


def assign_steps(catalog: DataFrame, order_by: str, series: str = "series") -> DataFrame:
    """Numbers the maps of each series 1..n in the given order. For catalogues: a row a map, not a row a cell."""
    return catalog.withColumn("step", F.row_number().over(W.partitionBy(series).orderBy(order_by)))


def dense_to_cells(rows: DataFrame, columns: int, values: str = "values", row: str = "row") -> DataFrame:
    """Rows of an array of numbers each, to one row a cell: cell_id, row, col, value."""
    flat = rows.select(F.col(row).cast("int").alias("row"), F.posexplode(values).alias("col", "value"))
    return flat.select((F.col("row").cast("long") * columns + F.col("col")).alias("cell_id"), "row", "col", "value")


def cells_to_dense(cells: DataFrame, by: tuple[str, ...] = ("row",)) -> DataFrame:
    """One array of values a map row, in the order of the columns."""
    packed = F.array_sort(F.collect_list(F.struct("col", "value")))
    return cells.groupBy(*by).agg(F.transform(packed, lambda x: x["value"]).alias("values"))


def clip_to_mask(df: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows of cells inside the basin."""
    return df.join(cells.where("mask").select("cell_id"), "cell_id", "left_semi")


NAMES = ("precipitation", "etp", "kp", "ndvi", "landuse")


def align_series(series: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """Long series (series, step, cell_id, value) side by side: one shuffle for all of them."""
    wide = series.groupBy("cell_id", "step").agg(*[F.max(F.when(F.col("series") == n, F.col("value"))).alias(n) for n in names])
    return wide.withColumn("landuse", F.col("landuse").cast("int")) if "landuse" in names else wide


def carry_forward_steps(catalog: DataFrame, first: int, last: int) -> DataFrame:
    """(step, effective_step) for each step of the window: the last step up to it, not before ``first``, that has a map.

    NULL where there is none yet. ``catalog`` is the (step) table of one series.
    """
    spark = catalog.sparkSession
    spine = spark.range(first, last + 1).select(F.col("id").cast("int").alias("step"))
    have = catalog.select(F.col("step").alias("have")).where(F.col("have").between(first, last)).distinct()
    joined = spine.join(F.broadcast(have), F.col("step") == F.col("have"), "left")
    # an as-of join over the steps alone: months, never cells
    return joined.select("step", F.last("have", ignorenulls=True).over(W.orderBy("step")).alias("effective_step"))


def carry_forward(series: DataFrame, first: int, last: int) -> DataFrame:
    """A series (cell_id, step, ...) with the last map before it for each step without one. The step table is broadcast; cells aren't shuffled."""
    steps = carry_forward_steps(series.select("step").distinct(), first, last)
    renamed = series.withColumnRenamed("step", "effective_step")
    return renamed.join(F.broadcast(steps), "effective_step").drop("effective_step")


def missing_steps(catalog: DataFrame, first: int, last: int) -> DataFrame:
    """Steps of the window without a map; for rain, evapotranspiration and pan coefficient each one is an error."""
    spark = catalog.sparkSession
    spine = spark.range(first, last + 1).select(F.col("id").cast("int").alias("step"))
    return spine.join(F.broadcast(catalog.select("step").distinct()), "step", "left_anti")


def raster_stats(series: DataFrame, by: tuple[str, ...] = ("series", "step")) -> DataFrame:
    """Minimum, maximum, mean and standard deviation of each map, NULL left out."""
    v = F.col("value")
    return series.groupBy(*by).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"), F.count_if(v.isNull()).alias("n_nodata"))


def series_min_max(series: DataFrame) -> DataFrame:
    """Smallest and largest value of each cell over a series; NULL left out."""
    return series.groupBy("cell_id").agg(F.min("value").alias("min"), F.max("value").alias("max"))


def series_lengths(series: DataFrame) -> DataFrame:
    """(series, n_steps, consistent): whether all series have equally many maps. A row a series, of which there are few."""
    n = series.groupBy("series").agg(F.count_distinct("step").alias("n_steps"))
    all_ = n.agg(F.collect_list(F.struct("series", "n_steps")).alias("s"), (F.min("n_steps") == F.max("n_steps")).alias("consistent"))
    return all_.select(F.inline("s"), "consistent")
