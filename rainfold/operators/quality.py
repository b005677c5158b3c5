"""Rules on maps, and the report on all inputs of a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..params import Parameters
from .lookup import check_landuse_table, uncovered_classes
from .series import series_lengths
from .small import small

INF = float("inf")
#: Layer: smallest and largest value, and whether nodata, all zeroes and all ones are forbidden (fixed values).
RULES = {
    "mask": (0.0, 1.0, False, True, False),
    "dem": (-100.0, 10000.0, True, True, True),
    "ldd": (1.0, 9.0, True, False, True),
    "ndvi_min": (-1.0, 1.0, True, False, False),
    "ndvi_max": (-1.0, 1.0, True, False, False),
    "soil": (0.0, INF, True, True, False),
    "samples": (0.0, INF, False, True, True),
    "etp": (0.0, INF, True, False, False),
    "precipitation": (0.0, INF, True, False, False),
    "kp": (0.0, 1.0, True, False, False),
    "ndvi": (-1.0, 1.0, True, False, False),
    "landuse": (0.0, INF, True, True, False),
}


def rules_table(spark: SparkSession) -> DataFrame:
    rows = [(k, *v) for k, v in RULES.items()]
    return spark.createDataFrame(rows, "layer string, lo double, hi double, forbid_nodata boolean, forbid_zeroes boolean, forbid_ones boolean")


def validate_layers(layers: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(layer, step, band, violation): the first rule that a map breaks, in the order range, nodata, zeroes, ones.

    ``layers``: layer, step, band, value, with NULL for nodata. Layers without rules have no violation. All rules come
    from one aggregation by map.
    """
    rules = rules_table(layers.sparkSession) if rules is None else rules
    v = F.col("value")
    ruled = layers.join(small(rules), "layer", "left")
    facts = ruled.groupBy("layer", "step", "band").agg(
        F.max(F.coalesce((v < F.col("lo")) | (v > F.col("hi")), F.lit(False))).alias("outside"),
        F.max(v.isNull()).alias("nodata"),
        F.min(F.coalesce(F.abs(v) <= 1e-8, F.lit(False))).alias("zeroes"),
        F.min(F.coalesce(F.abs(v - 1) <= 1e-8 + 1e-5, F.lit(False))).alias("ones"),
        *[F.first(c).alias(c) for c in ("forbid_nodata", "forbid_zeroes", "forbid_ones")],
    )
    first = (
        F.when(F.col("outside"), "FORBID_OUT_OF_RANGE")
        .when(F.col("nodata") & F.col("forbid_nodata"), "FORBID_NO_DATA")
        .when(F.col("zeroes") & F.col("forbid_zeroes"), "FORBID_ALL_ZEROES")
        .when(F.col("ones") & F.col("forbid_ones"), "FORBID_ALL_ONES")
    )
    return facts.select("layer", "step", "band", first.alias("violation"))


#: Which layer takes its classes from which table.
CLASS_LAYERS = {"landuse": "landuse", "soil": "soil"}


def input_report(cells: DataFrame, forcing: DataFrame, soil_attr: DataFrame, landuse_attr: DataFrame, params: Parameters, variables: tuple[str, ...] = ("arn",), stations: bool = True) -> DataFrame:
    """(description, reason, file, blocking) of all that is wrong with the inputs of a run."""
    spark = cells.sparkSession
    long = cells.select(F.lit(0).alias("step"), F.explode(F.array(*[F.struct(F.lit(c).alias("layer"), F.col(c).cast("double").alias("value")) for c in STATIC])).alias("x"))
    moving = forcing.select("step", F.explode(F.array(*[F.struct(F.lit(c).alias("layer"), F.col(c).cast("double").alias("value")) for c in MOVING])).alias("x"))
    layers = long.union(moving).select("x.layer", "step", F.lit(1).alias("band"), "x.value")
    broken = validate_layers(layers).where("violation is not null").select(F.lit("map rule").alias("description"), F.col("violation").alias("reason"), F.concat("layer", F.lit(" step "), "step").alias("file"), F.lit(True).alias("blocking"))
    classes = [
        uncovered_classes(df, c, t).select(F.lit("class without a row").alias("description"), F.col(c).cast("string").alias("reason"), F.lit(c).alias("file"), F.lit(True).alias("blocking"))
        for df, c, t in ((cells, "soil", soil_attr), (forcing, "landuse", landuse_attr))
    ]
    lengths = series_lengths(moving.select(F.col("x.layer").alias("series"), "step")).where(~F.col("consistent")).select(F.lit("series length").alias("description"), F.col("n_steps").cast("string").alias("reason"), F.col("series").alias("file"), F.lit(True).alias("blocking"))
    return reduce(DataFrame.union, [broken, *classes, lengths, *_given(spark, landuse_attr, params, variables, stations)])


def _given(spark: SparkSession, landuse_attr: DataFrame, params: Parameters, variables: tuple[str, ...], stations: bool) -> list[DataFrame]:
    """What is wrong with class table, parameters and outputs, as in ``input_report``."""
    table = check_landuse_table(landuse_attr).select(
        F.lit("class table rule").alias("description"),
        F.concat_ws(", ", F.when(F.col("bad_shares"), "shares"), F.when(F.col("bad_crop_coef"), "crop coefficients")).alias("reason"),
        F.concat(F.lit("landuse "), F.col("landuse").cast("string")).alias("file"),
        F.lit(False).alias("blocking"),
    )
    own = [("parameter", x, "parameters", True) for x in params.problems()]
    own += [] if variables else [("output", "no variable is enabled", "outputs", False)]
    own += [("output", "stations without any variable", "outputs", False)] if stations and not variables else []
    return [table, spark.createDataFrame(own, REPORT)]


REPORT = "description string, reason string, file string, blocking boolean"
STATIC = ("dem", "soil", "ndvi_min", "ndvi_max")
MOVING = ("precipitation", "etp", "kp", "ndvi", "landuse")


def _listed(x: Column) -> Column:
    """The distinct values that aren't NULL, as text."""
    return F.array_join(F.collect_set(x.cast("string")), ",")


def watched(stored: DataFrame, soil_attr: DataFrame, landuse_attr: DataFrame) -> tuple[DataFrame, Observation]:
    """A basin from ``store_basin`` that takes the facts for ``watched_report`` in the very scan of the run that reads it.

    The facts are sets: for each layer the steps that break a rule or keep one, and classes without a row in their table; at most
    steps x layers numbers a task. A task that runs twice adds nothing to a set, so lost executors don't change the report.
    """
    seen = [_listed(F.col("step")).alias("steps")]
    for layer in (*STATIC, *MOVING):
        lo, hi, nodata, zeroes, ones = RULES[layer]
        v, step = F.col(layer).cast("double"), F.lit(0) if layer in STATIC else F.col("step")
        facts = {"outside": (v < lo) | (v > hi)}
        facts |= {"nodata": v.isNull()} if nodata else {}
        facts |= {"other_than_0": F.coalesce(F.abs(v) > 1e-8, F.lit(True))} if zeroes else {}
        facts |= {"other_than_1": F.coalesce(F.abs(v - 1) > 1e-8 + 1e-5, F.lit(True))} if ones else {}
        seen += [_listed(F.when(broken, step)).alias(f"{layer}_{name}") for name, broken in facts.items()]
    for layer, table in (("soil", soil_attr), ("landuse", landuse_attr)):
        codes = [r[0] for r in table.select(layer).where(f"{layer} is not null").distinct().collect()]  # a class table: few rows
        seen.append(_listed(F.when(~F.col(layer).isin(codes), F.col(layer))).alias(f"{layer}_classes"))
    watch = Observation()
    return stored.observe(watch, *seen), watch


def watched_report(spark: SparkSession, watch: Observation, landuse_attr: DataFrame, params: Parameters, variables: tuple[str, ...] = ("arn",), stations: bool = True) -> DataFrame:
    """The rows of ``input_report``, from what the run has seen of its basin; waits for the run's first job.

    A basin holds cells that have forcing, and all series of a month side by side, so lengths of series can't differ
    any more; ``complete_forcing`` checks them before. An empty basin breaks no map rule.
    """
    got = {k: set(v.split(",")) - {""} for k, v in watch.get.items()}
    rows = []
    for layer in (*STATIC, *MOVING):
        there = (got["steps"] and {"0"}) if layer in STATIC else got["steps"]
        outside, nodata = got[f"{layer}_outside"], got.get(f"{layer}_nodata", set())
        rules = [
            ("FORBID_OUT_OF_RANGE", outside),
            ("FORBID_NO_DATA", nodata),
            ("FORBID_ALL_ZEROES", there - got.get(f"{layer}_other_than_0", there)),
            ("FORBID_ALL_ONES", there - got.get(f"{layer}_other_than_1", there)),
        ]
        first: dict[str, str] = {}
        for rule, steps in rules:
            first |= {s: rule for s in steps if s not in first}
        rows += [("map rule", rule, f"{layer} step {s}", True) for s, rule in first.items()]
    rows += [("class without a row", code, layer, True) for layer in ("soil", "landuse") for code in got[f"{layer}_classes"]]
    return reduce(DataFrame.union, [spark.createDataFrame(rows, REPORT), *_given(spark, landuse_attr, params, variables, stations)])


def domain_errors(rows: DataFrame, terms: dict[str, tuple[Column, tuple[str, ...]]], key: tuple[str, ...]) -> DataFrame:
    """(*key, term): the rows and terms at which ``strict`` formulas would raise an error.

    ``terms``: the plain (not strict) column of each term and the columns that it reads. A term is outside its domain where it is NULL
    though it reads no NULL; where it reads one it is NULL in both forms and raises nothing. One pass, no shuffle.
    """
    failed = [F.when(c.isNull() & reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in reads], F.lit(True)), F.lit(name)) for name, (c, reads) in terms.items()]
    return rows.select(*key, F.explode(F.array_compact(F.array(*failed))).alias("term"))
