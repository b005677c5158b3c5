"""A basin derived from order tables by plain SQL, which Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import terrain
from ..operators.storage import checkpointed, there
from ..params import Parameters

PARAMS = Parameters()

#: Land-use classes: code, manning, a_v, a_o, a_s, a_i, kc_min, kc_max (fixed values).
LANDUSE = [
    (0, 1, 0, 0, 0, 0, 0.65, 0.7),
    (3, 0.16, 1, 0, 0, 0, 1.14, 1.8),
    (4, 0.2, 1, 0, 0, 0, 1.14, 1.8),
    (5, 0.15, 0.7, 0, 0.3, 0, 0.7, 1),
    (9, 0.16, 1, 0, 0, 0, 1.14, 1.8),
    (11, 0.15, 0, 0, 0, 0, 0.7, 1),
    (12, 0.2, 0.9, 0, 0.1, 0, 0.55, 1),
    (13, 0.2, 0.9, 0, 0.1, 0, 0.55, 1),
    (15, 0.15, 0.8, 0, 0.2, 0, 0.55, 1),
    (18, 0.17, 0, 0, 0, 0, 0.65, 0.7),
    (19, 0.17, 0.8, 0, 0.2, 0, 0.4, 1.25),
    (20, 0.17, 0.8, 0, 0.2, 0, 0.55, 1),
    (21, 0.16, 0.8, 0, 0.2, 0, 0.65, 0.7),
    (23, 0.040, 0.3, 0, 0.7, 0, 0.2, 0.2),
    (24, 0.60, 0.4, 0.5, 0.1, 0, 0.2, 0.2),
    (25, 0.6, 0.4, 0.5, 0.1, 0, 0.7, 0.2),
    (27, 1, 0, 0, 0, 0, 0.65, 0.7),
    (29, 0.045, 0.2, 0, 0.4, 0.4, 0.2, 0.2),
    (30, 0.045, 0, 0, 1, 0, 0.65, 0.7),
    (31, 0.15, 0, 0, 0, 0, 0.65, 0.7),
    (32, 0.15, 0.7, 0, 0.3, 0, 0.65, 0.7),
    (33, 0.01, 0, 1, 0, 0, 0.65, 0.7),
]

#: Soil classes: code, bulk density, saturation (also taken for k_sat), root zone depth [cm], wilting point, field capacity (fixed values).
SOIL = [
    (1, 1.54, 0.46, 150.39, 0.12, 0.26),
    (2, 1.31, 0.55, 137.45, 0.1, 0.29),
    (3, 1.41, 0.47, 131.25, 0.03, 0.22),
    (4, 1.54, 0.42, 114.3, 0.12, 0.31),
    (5, 1.25, 0.58, 200.81, 0.22, 0.36),
    (6, 1.59, 0.33, 200.0, 0.03, 0.08),
    (7, 1.59, 0.33, 60.0, 0.03, 0.08),
    (8, 1.46, 0.43, 120.0, 0.15, 0.28),
    (9, 1.38, 0.52, 177.2, 0.22, 0.38),
    (10, 1.64, 0.38, 148.07, 0.08, 0.29),
    (11, 1.31, 0.33, 120.0, 0.06, 0.12),
    (12, 1.51, 0.47, 147.5, 0.11, 0.22),
    (13, 1.18, 0.54, 132.52, 0.18, 0.37),
    (14, 1.31, 0.45, 189.77, 0.12, 0.26),
    (15, 1.54, 0.42, 50.0, 0.17, 0.31),
    (16, 1.48, 0.47, 140.82, 0.13, 0.24),
    (17, 1.22, 0.56, 166.67, 0.24, 0.37),
]

#: Rainy days of each month (fixed values).
RAINY_DAYS = [(1, 16), (2, 13), (3, 12), (4, 7), (5, 7), (6, 6), (7, 5), (8, 4), (9, 7), (10, 10), (11, 11), (12, 14)]
DAYS_IN_MONTH = [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"CAST({x} AS DOUBLE)" if k else str(x) for k, x in enumerate(r)) + ")" for r in rows)


CELLS = """
    SELECT o_orderkey AS cell_id, CAST(floor(o_orderkey / 100) AS INT) AS r, CAST(o_orderkey % 100 AS INT) AS c,
        (SELECT floor(max(o_orderkey) / 100) FROM {orders}) * 2 - floor(o_orderkey / 100) * 2
            + abs(o_orderkey % 100 - 50) * CAST(0.5 AS DOUBLE) + (o_totalprice % 1) * CAST(0.4 AS DOUBLE) AS dem,
        CAST(o_custkey % 17 + 1 AS INT) AS soil,
        CAST(0.05 AS DOUBLE) + (o_custkey % 7) / CAST(100 AS DOUBLE) AS ndvi_min,
        CAST(0.7 AS DOUBLE) + (o_custkey % 11) / CAST(100 AS DOUBLE) AS ndvi_max,
        CASE WHEN o_orderkey % 497 = 5 THEN CAST(o_orderkey AS INT) END AS station_id,
        o_orderkey % 10 <> 9 AS mask
    FROM {orders}
"""

FORCING = f"""
    SELECT g.cell_id, s.step, coalesce(p.rain, CAST(0 AS DOUBLE)) AS precipitation,
        CAST(60 + (g.cell_id * 7 + s.step * 13) % 90 AS DOUBLE) AS etp,
        CAST(0.6 AS DOUBLE) + ((g.cell_id * 3 + s.step) % 30) / CAST(100 AS DOUBLE) AS kp,
        CAST(0.07 AS DOUBLE) + ((g.cell_id * 5 + s.step * 11) % 60) / CAST(100 AS DOUBLE) AS ndvi,
        u.landuse
    FROM (SELECT o_orderkey AS cell_id FROM {{orders}}) g
    CROSS JOIN (VALUES {", ".join(f"({k})" for k in range(1, 13))}) AS s(step)
    JOIN (VALUES {", ".join(f"({k}, {row[0]})" for k, row in enumerate(LANDUSE))}) AS u(place, landuse) ON u.place = (g.cell_id * 3 + CAST(floor(s.step / 7) AS INT)) % {len(LANDUSE)}
    LEFT JOIN (
        SELECT l_orderkey, CAST(month(l_shipdate) AS INT) AS step, 10 * sum(l_quantity) AS rain FROM {{lineitem}} GROUP BY l_orderkey, CAST(month(l_shipdate) AS INT)
    ) p ON p.l_orderkey = g.cell_id AND p.step = s.step
"""

STATION_OBS = """
    SELECT l_suppkey AS station_id, CAST(l_suppkey % 10 AS DOUBLE) AS lon, CAST(floor(l_suppkey / 10) % 60 AS DOUBLE) AS lat,
        CAST(month(l_shipdate) AS INT) AS step, sum(l_quantity) AS value
    FROM {lineitem} GROUP BY l_suppkey, CAST(month(l_shipdate) AS INT)
"""


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CELLS, **_tables(spark, sf_dir, "orders")).withColumnsRenamed({"r": "row", "c": "col"})


def forcing(spark: SparkSession, sf_dir: str, by_cell: bool = False) -> DataFrame:
    """``by_cell``: orders and lines are dealt out by their order before they become months, so that a table written from it (see ``storage.writing``) moves them, not the months."""
    found = _tables(spark, sf_dir, "orders", "lineitem")
    if by_cell:
        found = {n: df.repartition(k) for (n, df), k in zip(found.items(), ("o_orderkey", "l_orderkey"), strict=True)}
    return spark.sql(FORCING, **found)


#: Basins stored in this process, by application and folder.
STORED: dict[tuple[str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The basin with slope, network and forcing in buckets by block; derived from the order tables once a session, as a user stores a basin once and runs it often."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in STORED or not there(STORED[key]):
        from .basin import store_basin, with_slope

        ground = checkpointed(cells(spark, sf_dir))
        edges = terrain.drain_edges(ground.join(terrain.drain_direction(ground), "cell_id"))
        STORED[key] = store_basin(with_slope(ground, PARAMS.grid), forcing(spark, sf_dir, by_cell=True), checkpointed(edges))
    return STORED[key]


def station_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STATION_OBS, **_tables(spark, sf_dir, "lineitem"))


def soil_attr(spark: SparkSession) -> DataFrame:
    rows = [(k, float(dg), float(ts), float(zr), float(ts), float(wp), float(fc)) for k, dg, ts, zr, wp, fc in SOIL]
    return spark.createDataFrame(rows, "soil int, bulk_density double, k_sat double, rootzone_depth double, t_sat double, t_wp double, t_fcap double")


def landuse_attr(spark: SparkSession) -> DataFrame:
    rows = [(r[0], *map(float, r[1:])) for r in LANDUSE]
    return spark.createDataFrame(rows, "landuse int, manning double, a_v double, a_o double, a_s double, a_i double, kc_min double, kc_max double")


def months(spark: SparkSession) -> DataFrame:
    rows = [(k, k, float(d), n) for (k, d), n in zip(RAINY_DAYS, DAYS_IN_MONTH, strict=True)]
    return spark.createDataFrame(rows, "step int, month int, days double, days_in_month int")


def series(forcing_: DataFrame) -> DataFrame:
    """Forcing in the long form that monthly maps arrive in."""
    names = ("precipitation", "etp", "kp", "ndvi", "landuse")
    packed = F.array(*[F.struct(F.lit(n).alias("series"), F.col(n).cast("double").alias("value")) for n in names])
    return forcing_.select("cell_id", "step", F.explode(packed).alias("x")).select("x.series", "step", "cell_id", "x.value")


SOIL_SQL = f"SELECT * FROM (VALUES {_values([(k, dg, ts, zr, ts, wp, fc) for k, dg, ts, zr, wp, fc in SOIL])}) AS t(soil, bulk_density, k_sat, rootzone_depth, t_sat, t_wp, t_fcap)"
LANDUSE_SQL = f"SELECT * FROM (VALUES {_values(LANDUSE)}) AS t(landuse, manning, a_v, a_o, a_s, a_i, kc_min, kc_max)"
MONTHS_SQL = f"SELECT * FROM (VALUES {_values([(k, d, n) for (k, d), n in zip(RAINY_DAYS, DAYS_IN_MONTH, strict=True)])}) AS t(step, days, days_in_month)"
