"""Class tables: code to values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .small import small


def wide_lookup(tables: dict[str, DataFrame], code: str = "code") -> DataFrame:
    """One row a class with a column for each attribute; a class that a table lacks has NULL there."""
    named = [df.select(code, F.col("value").alias(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.join(b, code, "full"), named)


def uncovered_classes(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """Class codes that occur in ``df`` but have no row in ``table``."""
    seen = df.select(column).where(F.col(column).isNotNull()).distinct()
    return seen.join(small(table.select(column)), column, "left_anti")


def check_landuse_table(table: DataFrame) -> DataFrame:
    """Classes that break a rule: shares that don't sum to 1, or kc_max not above kc_min."""
    total = F.col("a_i") + F.col("a_o") + F.col("a_s") + F.col("a_v")
    shares = F.coalesce(F.abs(total - 1) > 1e-9, F.lit(True))
    crops = F.coalesce(F.col("kc_max") <= F.col("kc_min"), F.lit(True))
    return table.select("landuse", shares.alias("bad_shares"), crops.alias("bad_crop_coef")).where("bad_shares or bad_crop_coef")
