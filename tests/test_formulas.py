"""Single terms on hand-computed values, and their domains."""

import math

import pytest
from pyspark.sql import functions as F

from rainfold.functions import evapo, runoff, soil, vegetation


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def _held_back():
    leaf = math.log(2) / 0.463  # so that half of the light gets through
    most = 2.0 * leaf
    daily = most * (1 - 1 / (1 + 80.0 * 0.5 / most))
    return 0.5 * 80.0 * (1 - math.exp(-daily * 10.0 / (80.0 + 1e-5)))


def cases():
    return [
        (vegetation.simple_ratio(0.6), 4.0),
        (vegetation.crop_coef(0.3, 0.1, 0.9, 0.2, 1.0), 0.4),
        (vegetation.effective_crop_coef(0.5, 0.1, 0.9, 0.2, 1.0), 0.6),
        (vegetation.effective_crop_coef(0.105, 0.1, 0.9, 0.2, 1.0), 0.2),
        (vegetation.effective_crop_coef(F.lit(1.1) * 0.1, 0.1, 0.9, 0.2, 1.0), 0.0),
        (vegetation.fpar(0.1, 0.9, 2.0, 1.0, 5.0), 0.3),
        (vegetation.fpar(0.1, 0.9, 9.0, 1.0, 5.0), 0.9),
        (vegetation.leaf_area_index(0.75, 0.9375, 3.0), 1.5),
        (vegetation.interception(2.0, math.log(2) / 0.463, 80.0, 10.0, 0.5), _held_back()),
        (vegetation.interception(2.0, 3.0, 0.0, 10.0, 0.5), 0.0),
        (evapo.water_stress(5.0, 2.0, 9.0), 2 / 3),
        (evapo.water_stress(1.5, 2.0, 9.0), 0.0),
        (evapo.et_vegetated(50.0, 0.8, 0.5), 20.0),
        (evapo.pan_coefficient(math.e, 10.0, 60.0), 0.77224),
        (evapo.et_open_water(6.0, 3.0, 1.5, 1.0), 1.5),
        (evapo.et_open_water(3.0, 1.5, 2.5, 0.4), 2.0),
        (evapo.et_open_water(3.0, 1.5, 2.5, 1.0), 2.0),
        (evapo.et_open_water(6.0, 3.0, 1.5, 0.4), 2.0),
        (evapo.et_bare_soil(40.0, 0.5, 0.25), 5.0),
        (evapo.et_bare_soil(40.0, 0.5, 0.0), 0.0),
        (evapo.et_bare_soil(40.0, 0.5, -0.5), -10.0),
        (evapo.et_impervious(2.5, 3.0), 2.5),
        (evapo.et_impervious(2.5, 0.0), 0.0),
        (evapo.total_et(0.1, 1.0, 0.2, 2.0, 0.3, 3.0, 0.4, 4.0), 3.0),
        (runoff.soil_moisture_coef(180.0, 1.5, 40.0, 1.2, 2.0), 0.0625),
        (runoff.permeable_runoff_coef(120.0, 1.5, 40.0, 10.0, 0.04, 0.2, 0.4, 0.4), 0.2 * 0.5 + 0.4 * 0.25 + 0.4 * 0.5),
        (runoff.impervious_share(0.25, 0.5), 0.75),
        (runoff.impervious_runoff_coef(0.5), 0.29881052),
        (runoff.weighted_runoff_coef(0.25, 0.4, 0.8), 0.5),
        (runoff.actual_runoff_coef(0.5, 8.0, 4.0), 2 / 3),
        (soil.lateral_flow(0.4, 2.0, 150.0, 300.0), 0.2),
        (soil.lateral_flow(0.5, 2.0, 300.0, 300.0), 1.0),
        (soil.recharge(0.4, 2.0, 150.0, 300.0), 0.3),
        (soil.baseflow(4.0, math.log(2), 2.0, 6.0, 5.0), 3.0),
        (soil.baseflow(4.0, math.log(2), 2.0, 5.0, 5.0), 0.0),
        (soil.saturated_storage(7.0, 3.0, 2.5), 7.5),
        (soil.soil_capacity(0.4, 1.5, 50.0), 300.0),
        (soil.discharge_m3s(86.4, 1e6, 1.0), 1.0),
    ]


def test_values(spark):
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, (c, _) in enumerate(cases())]).first()
    for k, (_, want) in enumerate(cases()):
        assert row[k] == pytest.approx(want, rel=1e-6, abs=1e-12), k


@pytest.mark.parametrize(
    ("a_o", "p", "eto", "s", "want"),
    [(1, 2, 1, 1, 1), (1, 2, 1, 1.5, 2), (1, 1, 1, 1, 0), (1, 1, 1, 2, 0), (0.998, 2, 1, 1, 1), (0.998, 2, 1, 2, 1), (0.998, 1, 1, 1, 0), (0.998, 1, 1, 2, 0)],
)
def test_surface_runoff(spark, a_o, p, eto, s, want):
    assert value(spark, runoff.surface_runoff(1.0, 1.0, float(p), 1.0, float(a_o), float(eto), float(s), 1.0)) == pytest.approx(want)


@pytest.mark.parametrize(
    ("previous", "a_o", "tsat", "want"),
    [(5, 1.1, 5.5, 5), (5, 1.1, 4.5, 4.5), (1, 1.1, 5.5, 1), (5, 1.0, 5.5, 5.5), (5, 1.0, 4.5, 4.5), (5, 1.1, 0, 0), (-9, 1.1, 5.5, 0)],
)
def test_soil_moisture(spark, previous, a_o, tsat, want):
    got = soil.soil_moisture(float(previous), 5.0, 1.0, 1.0, 1.0, 1.0, 1.0, float(a_o), float(tsat))
    assert value(spark, got) == pytest.approx(want)


BAD = [
    lambda strict: vegetation.simple_ratio(1.0, strict),
    lambda strict: vegetation.crop_coef(0.5, 0.1, 0.1, 0.4, 0.9, strict),
    lambda strict: vegetation.fpar(0.5, 0.9, 1.0, 1.5, 1.5, strict),
    lambda strict: vegetation.leaf_area_index(1.0, 0.9, 1.0, strict),
    lambda strict: vegetation.leaf_area_index(0.5, 1.0, 1.0, strict),
    lambda strict: vegetation.interception(0.0, 12.0, 10.0, 3.0, 0.5, strict),
    lambda strict: evapo.water_stress(2.0, 1.0, 1.0, strict),
    lambda strict: evapo.water_stress(2.0, 3.0, 1.0, strict),
    lambda strict: evapo.pan_coefficient(0.0, 1.0, 1.0, strict),
    lambda strict: runoff.soil_moisture_coef(1.0, 0.0, 1.0, 1.0, 1.0, strict),
    lambda strict: runoff.permeable_runoff_coef(1.0, 1.0, 1.0, -10.0, 1.0, 0.3, 0.3, 0.4, strict),
    lambda strict: runoff.actual_runoff_coef(0.0, 0.0, 0.0, strict),
    lambda strict: soil.lateral_flow(1.0, 1.0, 1.0, 0.0, strict),
]


@pytest.mark.parametrize("k", range(len(BAD)))
def test_domain(spark, k):
    assert value(spark, BAD[k](False)) is None
    with pytest.raises(Exception, match="is 0|<= 0"):
        value(spark, BAD[k](True))


def test_null_stays_null(spark):
    null = F.lit(None).cast("double")
    terms = [
        vegetation.simple_ratio(null),
        vegetation.fpar(0.1, null, 1.0, 0.5, 2.0),
        vegetation.effective_crop_coef(0.5, 0.1, 0.9, null, 1.0),
        evapo.et_open_water(4.0, 2.0, null, 1.0),
        runoff.surface_runoff(null, 1.0, 2.0, 1.0, 1.0, 1.0, 1.0, 1.0),
        soil.soil_moisture(null, 5.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 5.0),
        soil.baseflow(1.0, 1.0, null, 0.5, 1.0),
    ]
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(terms)]).first()
    assert list(row) == [None] * len(terms)
