"""Parameter sweeps, goodness of fit and values from gauge records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sweep(rows: DataFrame, param_sets: list[dict[str, float]], key: str = "param_id") -> DataFrame:
    """Each row with each parameter set, numbered from 1 in ``key``. The sets are a list in the plan, so there is no join."""
    sets = F.array(*[F.struct(F.lit(k).alias(key), *[F.lit(float(v)).alias(n) for n, v in s.items()]) for k, s in enumerate(param_sets, 1)])
    return rows.select("*", F.explode(sets).alias("_set")).select(*rows.columns, "_set.*")


def goodness_of_fit(df: DataFrame, by: tuple[str, ...], observed: str = "observed", simulated: str = "simulated") -> DataFrame:
    """(*by, n, rmse, nse, r, mean_error, relative_bias) from one pass of sums; pairs with a NULL are left out."""
    o, s = F.col(observed), F.col(simulated)
    both = df.where(o.isNotNull() & s.isNotNull())
    mean_error = F.avg(s - o)
    return both.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg((s - o) * (s - o))).alias("rmse"),
        (1 - F.try_divide(F.sum((s - o) * (s - o)), F.var_pop(o) * F.count("*"))).alias("nse"),
        F.try_divide(F.covar_pop(o, s), F.stddev_pop(o) * F.stddev_pop(s)).alias("r"),
        mean_error.alias("mean_error"),
        F.try_divide(mean_error, F.avg(o)).alias("relative_bias"),
    )


def rank_parameter_sets(fits: DataFrame, k: int, by: str = "nse") -> DataFrame:
    """The k sets that fit best."""
    return fits.orderBy(F.desc_nulls_last(by), *[c for c in fits.columns if c.endswith("_id")]).limit(k)


def baseflow_seed(obs: DataFrame, seconds: float, grid_area: float) -> DataFrame:
    """(station_id, bfw_ini, bfw_lim) from flow records (station_id, area [m2], flow [m3/s]): mean and least flow * seconds / (area * cells) * 1e-3."""
    scale = F.lit(seconds * 1e-3) / (F.col("area") * (F.col("area") / grid_area))
    stats = obs.groupBy("station_id", "area").agg(F.avg("flow").alias("mean"), F.min("flow").alias("least"))
    return stats.select("station_id", (F.col("mean") * scale).alias("bfw_ini"), (F.col("least") * scale).alias("bfw_lim"))
