"""The test basin's operators once more, as plain SQL for another engine."""

from __future__ import annotations

import re
from dataclasses import replace

from . import testgrid as g

P = g.PARAMS

def _balance(P, s: str = "", forcing: str = "forcing") -> dict[str, tuple[str, str]]:
    """The parts free, fold and balance for a set of parameters, with a suffix."""
    return {
    f"free{s}": (
        f"cells {forcing} soil_attr landuse_attr months slope",
        f"""SELECT *, weighted * (precipitation / days) / (weighted * (precipitation / days) - {P.rcd} * weighted + {P.rcd}) AS runoff_coef FROM (
            SELECT *,
                a_v * precipitation * (1 - exp(-(({P.alpha} * lai * (1 - 1 / (1 + precipitation * (1 - exp(-0.463 * lai)) / ({P.alpha} * lai)))) * days / (precipitation + 1e-5)))) AS itp,
                (ndvi > 1.1 * ndvi_min)::INT * (kc_min + (kc_max - kc_min) * (ndvi - ndvi_min) / (ndvi_max - ndvi_min)) + (ndvi < 1.1 * ndvi_min)::INT * kc_min AS kc,
                CASE WHEN a_o = 1 AND etp / kp > precipitation THEN precipitation ELSE etp / kp END AS et_o,
                {P.i_imp} * (precipitation <> 0)::INT AS et_i,
                (1 - a_o - a_i) * ({P.w_1} * 0.02 / manning + {P.w_2} * (wp / mass) / (1 - wp / mass) + {P.w_3} * slope / (10 + slope)) + (a_o + a_i) * 0.09 * exp(2.4 * (a_o + a_i)) AS weighted
            FROM (
                SELECT *, {P.lai_max} * log10(1 - fpar) / log10(1 - {P.fpar_max}::DOUBLE) AS lai FROM (
                    SELECT *, least({P.fpar_max}::DOUBLE, {P.fpar_min} + ((1 + ndvi) / (1 - ndvi) - (1 + ndvi_min) / (1 - ndvi_min)) * ({P.fpar_max} - {P.fpar_min}) / ((1 + ndvi_max) / (1 - ndvi_max) - (1 + ndvi_min) / (1 - ndvi_min))) AS fpar,
                        bulk_density * rootzone_depth * 10 AS mass, t_sat * bulk_density * rootzone_depth * 10 AS tsat, t_wp * bulk_density * rootzone_depth * 10 AS wp, t_fcap * bulk_density * rootzone_depth * 10 AS fc
                    FROM {forcing} JOIN cells USING (cell_id) JOIN soil_attr USING (soil) JOIN landuse_attr USING (landuse) JOIN months USING (step) JOIN slope USING (cell_id))))""",
    ),
    f"fold{s}": (
        f"free{s}",
        f"""SELECT cell_id, 0 AS step, 0.0::DOUBLE AS itp, 0.0::DOUBLE AS eta, 0.0::DOUBLE AS srn, 0.0::DOUBLE AS lfw, 0.0::DOUBLE AS rec, {P.bfw_ini}::DOUBLE AS bfw, tsat * {P.t_ini} AS smc, {P.s_sat_ini}::DOUBLE AS sat FROM free{s} WHERE step = 1
        UNION ALL
        SELECT cell_id, step, itp, eta, srn, lfw, rec, bfw,
            CASE WHEN a_o = 1 THEN tsat WHEN before + precipitation - itp - srn - lfw - rec - eta <= 0 THEN 0 WHEN before + precipitation - itp - srn - lfw - rec - eta >= tsat THEN tsat ELSE before + precipitation - itp - srn - lfw - rec - eta END AS smc,
            held + rec - bfw AS sat
        FROM (
            SELECT *, (base * exp(-{P.alpha_gw}::DOUBLE) + (1 - exp(-{P.alpha_gw}::DOUBLE)) * rec) * (held > {P.bfw_lim})::INT AS bfw FROM (
                SELECT f.*, p.smc AS before, p.sat AS held, p.bfw AS base,
                    a_i * et_i + a_o * et_o + etp * (a_v * kc + a_s * kc_min) * ln(CASE WHEN p.smc > wp THEN p.smc - wp ELSE 0 END + 1) / ln(fc - wp + 1) AS eta,
                    CASE WHEN a_o = 1 THEN greatest(precipitation - et_o, 0) * CASE WHEN p.smc = tsat THEN 1 ELSE 2 END
                        WHEN p.smc = tsat THEN precipitation - f.itp ELSE runoff_coef * pow(p.smc / mass / tsat, {P.beta}) * (precipitation - f.itp) END AS srn,
                    {P.f} * k_sat * (p.smc / tsat) * (p.smc / tsat) AS lfw,
                    (1 - {P.f}) * k_sat * (p.smc / tsat) * (p.smc / tsat) AS rec
                FROM fold{s} p JOIN free{s} f ON f.cell_id = p.cell_id AND f.step = p.step + 1))""",
    ),
        f"balance{s}": (f"fold{s}", f"SELECT *, srn + lfw + bfw AS rnf FROM fold{s} WHERE step > 0"),
    }


#: Named parts, each with those it reads.
PARTS = {
    "cells": ("", g.CELLS.format(orders="orders")),
    "forcing": ("", g.FORCING.format(orders="orders", lineitem="lineitem")),
    "obs": ("", g.STATION_OBS.format(lineitem="lineitem")),
    "soil_attr": ("", g.SOIL_SQL),
    "landuse_attr": ("", g.LANDUSE_SQL),
    "months": ("", g.MONTHS_SQL),
    "nb": (
        "cells",
        """SELECT a.cell_id, a.code, b.cell_id AS neighbour_id, a.dem AS value, b.dem AS neighbour_value
        FROM (SELECT cell_id, dem, code, r + dr AS r, c + dc AS c FROM cells CROSS JOIN (VALUES (7, -1, -1), (8, -1, 0), (9, -1, 1), (4, 0, -1), (6, 0, 1), (1, 1, -1), (2, 1, 0), (3, 1, 1)) AS o(code, dr, dc)) a
        JOIN cells b ON b.r = a.r AND b.c = a.c""",
    ),
    "slope": (
        "cells nb",
        f"""SELECT cells.cell_id, coalesce(sqrt(dx * dx + dy * dy), 0) AS slope FROM cells LEFT JOIN (
            SELECT cell_id,
                sum((neighbour_value - value) * CASE code WHEN 6 THEN 2 WHEN 9 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN -2 WHEN 7 THEN -1 WHEN 1 THEN -1 ELSE 0 END) / (8 * {P.grid}) AS dx,
                sum((neighbour_value - value) * CASE code WHEN 2 THEN 2 WHEN 1 THEN 1 WHEN 3 THEN 1 WHEN 8 THEN -2 WHEN 7 THEN -1 WHEN 9 THEN -1 ELSE 0 END) / (8 * {P.grid}) AS dy
            FROM nb GROUP BY cell_id) t USING (cell_id)""",
    ),
    "ldd": (
        "cells nb",
        """SELECT cells.cell_id, coalesce(code, 5) AS ldd FROM cells LEFT JOIN (
            SELECT cell_id, code, row_number() OVER (PARTITION BY cell_id ORDER BY fall DESC, code) AS k FROM (
                SELECT cell_id, code, (value - neighbour_value) / CASE WHEN code IN (7, 9, 1, 3) THEN sqrt(2) ELSE 1 END AS fall FROM nb)
            WHERE fall > 0) t ON t.cell_id = cells.cell_id AND k = 1""",
    ),
    "drain": (
        "ldd cells",
        """SELECT f.cell_id, t.cell_id AS down_id FROM (
            SELECT cell_id, r + CASE WHEN ldd IN (7, 8, 9) THEN -1 WHEN ldd IN (1, 2, 3) THEN 1 ELSE 0 END AS r, c + CASE WHEN ldd IN (7, 4, 1) THEN -1 WHEN ldd IN (9, 6, 3) THEN 1 ELSE 0 END AS c, ldd FROM ldd JOIN cells USING (cell_id)) f
        LEFT JOIN cells t ON t.r = f.r AND t.c = f.c AND f.ldd <> 5""",
    ),
    "below": ("drain cells", "SELECT cell_id, cell_id AS at FROM cells UNION ALL SELECT b.cell_id, d.down_id FROM below b JOIN drain d ON d.cell_id = b.at WHERE d.down_id IS NOT NULL"),
    "flow": ("balance months", f"SELECT cell_id, step, rnf * {P.area} * 0.001 / (days_in_month * 86400) AS q FROM balance JOIN months USING (step)"),
    "smooth": (
        "flow cells",
        f"SELECT cell_id, 0 AS step, 0.0::DOUBLE AS q FROM cells UNION ALL SELECT f.cell_id, f.step, {P.x} * s.q + (1 - {P.x}) * f.q FROM smooth s JOIN flow f ON f.cell_id = s.cell_id AND f.step = s.step + 1",
    ),
    "arn": ("smooth below", "SELECT b.at AS cell_id, s.step, sum(s.q) AS arn FROM below b JOIN smooth s ON s.cell_id = b.cell_id WHERE s.step > 0 GROUP BY b.at, s.step"),
    "long": (
        "forcing",
        "SELECT 'precipitation' AS series, step, cell_id, precipitation AS value FROM forcing UNION ALL SELECT 'etp', step, cell_id, etp FROM forcing UNION ALL SELECT 'kp', step, cell_id, kp FROM forcing"
        " UNION ALL SELECT 'ndvi', step, cell_id, ndvi FROM forcing UNION ALL SELECT 'landuse', step, cell_id, landuse::DOUBLE FROM forcing",
    ),
}


#: Parameter sets of the sweep.
SETS = [{"beta": 0.5, "f": 0.5}, {"beta": 0.9, "f": 0.3}, {"beta": 0.2, "f": 0.8}]

PARTS |= _balance(P)
for _k, _set in enumerate(SETS, 1):
    PARTS |= _balance(replace(P, **_set), f"_{_k}")
#: Forcing with months that lack a map of NDVI (5, 6) or land use (3).
PARTS["gaps"] = (
    "forcing",
    """SELECT f.cell_id, f.step, f.precipitation, f.etp, f.kp, n.ndvi, u.landuse FROM forcing f
    JOIN forcing n ON n.cell_id = f.cell_id AND n.step = CASE WHEN f.step IN (5, 6) THEN 4 ELSE f.step END
    JOIN forcing u ON u.cell_id = f.cell_id AND u.step = CASE WHEN f.step = 3 THEN 2 ELSE f.step END""",
)
PARTS |= _balance(P, "_gaps", "gaps")
#: Semivariogram by planar lags, and stations at places of their own.
PARTS["lags"] = (
    "obs",
    """SELECT step, lag, avg(d) AS distance, avg(g) AS gamma, count(*) AS n FROM (
        SELECT step, d, g, least(greatest(ceil(d / max(d) OVER (PARTITION BY step) * 25)::INT, 1), 25) AS lag FROM (
            SELECT a.step, sqrt((a.lon - b.lon) ** 2 + (a.lat - b.lat) ** 2) AS d, (a.value - b.value) ** 2 / 2 AS g FROM obs a JOIN obs b ON a.step = b.step AND a.station_id < b.station_id)) GROUP BY step, lag""",
)
#: The same along great circles, and the spherical model fitted to it; kriging by an elimination with pivots, one column a turn.
GREAT_CIRCLE = "degrees(2 * asin(least(1.0, sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2))))"
PARTS["lags_geo"] = ("obs", PARTS["lags"][1].replace("sqrt((a.lon - b.lon) ** 2 + (a.lat - b.lat) ** 2)", GREAT_CIRCLE))
MODEL = """SELECT step, span, sill, nugget FROM (
        SELECT *, row_number() OVER (PARTITION BY step ORDER BY round((gg - sill * bg - nugget * g) / gg, 8), k) AS place FROM (
            SELECT step, k, span, bg, g, gg, CASE WHEN s0 >= 0 AND n0 >= 0 THEN s0 WHEN bg >= 0 THEN bg / bb ELSE 0 END AS sill, CASE WHEN s0 >= 0 AND n0 >= 0 THEN n0 WHEN bg >= 0 THEN 0 ELSE g / w END AS nugget FROM (
                SELECT *, CASE WHEN bb * w - b * b > 1e-9 * bb * w THEN (bg * w - b * g) / (bb * w - b * b) ELSE g / w / 2 END AS s0, CASE WHEN bb * w - b * b > 1e-9 * bb * w THEN (bb * g - b * bg) / (bb * w - b * b) ELSE g / w / 2 END AS n0 FROM (
                    SELECT step, k, span, sum(n * base * base) AS bb, sum(n * base) AS b, sum(n) AS w, sum(n * base * gamma) AS bg, sum(n * gamma) AS g, sum(n * gamma * gamma) AS gg FROM (
                        SELECT *, 1.5 * least(distance / span, 1) - 0.5 * least(distance / span, 1) ** 3 AS base FROM (
                            SELECT v.*, s.k, (0.05 + (1.5 - 0.05) / 59 * s.k) * max(distance) OVER (PARTITION BY step, s.k) AS span FROM {lags} v CROSS JOIN (SELECT range AS k FROM range(60)) s)) GROUP BY step, k, span))))
    WHERE place = 1"""
PARTS["model"] = ("lags", MODEL.format(lags="lags"))
PARTS["model_geo"] = ("lags_geo", MODEL.format(lags="lags_geo"))
GAMMA = "CASE WHEN d > 0 THEN nugget + sill * (1.5 * least(d / span, 1) - 0.5 * least(d / span, 1) ** 3) ELSE 0 END"
PARTS["placed"] = ("obs", "SELECT *, row_number() OVER (PARTITION BY step ORDER BY station_id) AS i, count(*) OVER (PARTITION BY step) AS m FROM obs")
#: Rows of the bordered systems: gammas, a one, the value; at last a row of ones, a zero and a zero.
PARTS["systems"] = (
    "placed model_geo",
    f"""SELECT step, i, list_concat(list({GAMMA} ORDER BY j), [1.0::DOUBLE, any_value(value)::DOUBLE]) AS x FROM (
        SELECT a.step, a.i, b.i AS j, a.value, {GREAT_CIRCLE} AS d, span, sill, nugget FROM placed a JOIN placed b ON a.step = b.step JOIN model_geo t ON t.step = a.step) GROUP BY step, i
    UNION ALL SELECT step, m + 1, list_concat(list(1.0::DOUBLE ORDER BY i), [0.0::DOUBLE, 0.0::DOUBLE]) FROM placed GROUP BY step, m""",
)
PARTS["solved"] = (
    "systems",
    """SELECT step, 0 AS turn, i, 0 AS done, x FROM systems
    UNION ALL
    SELECT step, turn + 1, i, CASE WHEN i = chosen THEN turn + 1 ELSE done END,
        CASE WHEN i = chosen THEN list_transform(x, lambda v: v / head[turn + 1]) ELSE list_transform(list_zip(x, head), lambda v: v[1] - x[turn + 1] / head[turn + 1] * v[2]) END
    FROM (
        SELECT *, arg_max(i, CASE WHEN done = 0 THEN abs(x[turn + 1]) ELSE -1 END) OVER w AS chosen, arg_max(x, CASE WHEN done = 0 THEN abs(x[turn + 1]) ELSE -1 END) OVER w AS head, count(*) OVER w AS size
        FROM solved WINDOW w AS (PARTITION BY step))
    WHERE turn < size""",
)
PARTS["duals"] = ("solved", "SELECT step, done AS i, x[len(x)] AS dual FROM solved WHERE turn = len(x) - 1")
PARTS["spots"] = ("obs", "SELECT station_id, step, value::DOUBLE AS value FROM obs")


def _stored(name: str) -> str:
    """Parts that don't refer to themselves are worked out once."""
    return "" if re.search(rf"(FROM|JOIN) {name}\b", PARTS[name][1]) else "MATERIALIZED "


def sql(select: str, *parts: str) -> str:
    """The query with the parts that it reads, in order."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in PARTS[name][0].split():
            need(x)
        if name not in order:
            order.append(name)

    for part in parts:
        need(part)
    if not order:
        return select
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {_stored(n)}({PARTS[n][1]})" for n in order) + "\n" + select
