"""Months and their numbers: step 1 is the alignment month."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .small import small


def period(start: date, end: date, alignment: date | None = None) -> tuple[int, int, int]:
    """(first step, last step, number of steps) of a run; ValueError unless alignment <= start < end."""
    alignment = alignment or start
    if not start < end:
        raise ValueError("start is not before end")
    if alignment > start:
        raise ValueError("alignment is after start")
    months = lambda d: 12 * d.year + d.month
    first, last = months(start) - months(alignment) + 1, months(end) - months(alignment) + 1
    return first, last, last - first + 1


def month_of_step(step: Column, alignment: date) -> Column:
    return F.add_months(F.lit(alignment.replace(day=1)), step - 1)


def calendar(spark: SparkSession, start: date, end: date, alignment: date | None = None) -> DataFrame:
    """(step, month_start, month, days_in_month) for each month of the period."""
    first, last, _ = period(start, end, alignment)
    steps = spark.range(first, last + 1).select(F.col("id").cast("int").alias("step"))
    dated = steps.withColumn("month_start", month_of_step(F.col("step"), alignment or start))
    return dated.withColumns({"month": F.month("month_start"), "days_in_month": F.day(F.last_day("month_start"))})


def with_rainy_days(months: DataFrame, rainy_days: DataFrame) -> DataFrame:
    """Adds ``days`` by month; the table has twelve rows."""
    return months.join(small(rainy_days), "month", "left")


def clip_period(series: DataFrame, first: int, last: int) -> DataFrame:
    """The steps of the simulation window; prunes partitions where ``step`` is one."""
    return series.where(F.col("step").between(first, last))
