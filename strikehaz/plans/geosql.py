"""The distance formulas as SQL text, for the oracle side only."""

from __future__ import annotations

import math

from strikehaz.functions import geo


def _q(phi: str) -> str:
    s = f"sin({phi})"
    return f"({1 - geo.E2!r} * ({s} / (1 - {geo.E2!r} * {s} * {s}) - ln((1 - {geo.E!r} * {s}) / (1 + {geo.E!r} * {s})) / {2 * geo.E!r}))"


def region(lon: str, lat: str) -> str:
    return (
        f"CASE WHEN {lon} BETWEEN -125 AND -66 AND {lat} BETWEEN 24 AND 50 THEN 'conus' "
        f"WHEN {lon} BETWEEN -25 AND 45 AND {lat} BETWEEN 34 AND 72 THEN 'europe' END"
    )


def albers(lon: str, lat: str) -> tuple[str, str]:
    rho = f"({geo.A!r} * sqrt({geo.ALBERS_C!r} - {geo.ALBERS_N!r} * {_q(f'radians({lat})')}) / {geo.ALBERS_N!r})"
    theta = f"({geo.ALBERS_N!r} * radians({lon} - ({geo.ALBERS_LON0!r})))"
    return f"({rho} * sin({theta}))", f"({geo.ALBERS_RHO0!r} - {rho} * cos({theta}))"


def _laea(lon: str, lat: str) -> tuple[str, str]:
    beta = f"asin({_q(f'radians({lat})')} / {geo.LAEA_QP!r})"
    dlon = f"radians({lon} - {geo.LAEA_LON0!r})"
    cb, sb = math.cos(geo.LAEA_BETA1), math.sin(geo.LAEA_BETA1)
    b = f"({geo.LAEA_RQ!r} * sqrt(2 / (1 + {sb!r} * sin({beta}) + {cb!r} * cos({beta}) * cos({dlon}))))"
    return (
        f"({b} * {geo.LAEA_D!r} * cos({beta}) * sin({dlon}))",
        f"({b} / {geo.LAEA_D!r} * ({cb!r} * sin({beta}) - {sb!r} * cos({beta}) * cos({dlon})))",
    )


def placed_cte(name: str, source: str, lon: str, lat: str, keep: str) -> str:
    """CTE with `keep`, lon, lat, region and projected x, y of each row of `source`."""
    (ax, ay), (lx, ly) = albers("lon", "lat"), _laea("lon", "lat")
    return (
        f"{name} AS (SELECT *, CASE WHEN reg = 'conus' THEN {ax} WHEN reg = 'europe' THEN {lx} END AS x, "
        f"CASE WHEN reg = 'conus' THEN {ay} WHEN reg = 'europe' THEN {ly} END AS y FROM "
        f"(SELECT *, {region('lon', 'lat')} AS reg FROM (SELECT {keep}, {lon} AS lon, {lat} AS lat FROM {source})))"
    )


def geodesic_ctes(source: str, out: str, lon1="lon1", lat1="lat1", lon2="lon2", lat2="lat2") -> str:
    """CTE chain adding geodesic_km to the rows of `source` (Thomas' second-order form)."""
    f = geo.F_WGS84
    t1, t2 = [f"atan({1 - f!r} * tan(radians({lat})))" for lat in (lat1, lat2)]
    second = "gx * (ga + (gr - (ga + ge) / 2) * gx) + gy * (ge * gy - 2 * gq) + gq * gx * gy"
    return (
        f"{out}_1 AS (SELECT *, ({t1} + {t2}) / 2 AS gm, ({t2} - {t1}) / 2 AS gt, radians({lon2} - {lon1}) / 2 AS gl FROM {source}), "
        f"{out}_2 AS (SELECT *, greatest(least(pow(sin(gt), 2) + pow(sin(gl), 2) * (pow(cos(gt), 2) - pow(sin(gm), 2)), 1), 0) AS gh FROM {out}_1), "
        f"{out}_3 AS (SELECT *, 2 * asin(sqrt(gh)) AS gd, 2 * pow(sin(gm) * cos(gt), 2) / greatest(1 - gh, 1e-15) AS gu, "
        f"2 * pow(sin(gt) * cos(gm), 2) / nullif(gh, 0) AS gw, 2 * (2 * gh - 1) AS ge FROM {out}_2), "
        f"{out}_4 AS (SELECT *, gd / greatest(sin(gd), 1e-15) AS gr, gu + gw AS gx, gu - gw AS gy FROM {out}_3), "
        f"{out}_5 AS (SELECT *, 4 * gr * gr AS gq, -4 * gr * gr * ge AS ga FROM {out}_4), "
        f"{out} AS (SELECT * EXCLUDE (gm, gt, gl, gh, gd, gu, gw, ge, gr, gx, gy, gq, ga), CASE WHEN gh = 0 THEN 0e0 ELSE "
        f"{geo.A / 1000!r} * sin(gd) * (gr - {f / 4!r} * (gr * gx - gy) + {f ** 2 / 64!r} * ({second})) END AS geodesic_km FROM {out}_5)"
    )


def pair_distance_ctes(left: str, right: str, out: str = "pairs", on: str | None = None) -> str:
    """CTE chain: every left-right pair of two `placed` CTEs (or those meeting `on`) with distance_km.

    Columns of the sides arrive as l_* and r_* structs flattened by the caller's
    names: left columns keep their names plus lon1.., right ones lon2...
    """
    join = f"JOIN {right} r ON {on}" if on else f"CROSS JOIN {right} r"
    base = (
        f"{out}_base AS (SELECT l.* EXCLUDE (lon, lat, reg, x, y), r.* EXCLUDE (lon, lat, reg, x, y), l.lon AS lon1, l.lat AS lat1, l.reg AS reg1, "
        f"l.x AS x1, l.y AS y1, r.lon AS lon2, r.lat AS lat2, r.reg AS reg2, r.x AS x2, r.y AS y2 FROM {left} l {join})"
    )
    return (
        base + ", " + geodesic_ctes(f"{out}_base", f"{out}_geo") + f", {out} AS (SELECT *, CASE WHEN reg1 = reg2 THEN "
        f"sqrt(pow(x1 - x2, 2) + pow(y1 - y2, 2)) / 1000 ELSE geodesic_km END AS distance_km FROM {out}_geo)"
    )
