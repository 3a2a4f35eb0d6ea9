"""DuckDB SQL for the raster queries. Every statement derives the same DEM from lineitem."""

from __future__ import annotations


def dem(width: int = 64, trend: int = 0, name: str = "dem") -> str:
    z = "CAST(SUM(CAST(l_quantity AS BIGINT)) % 97 AS DOUBLE)"
    z = f"CAST({trend} AS DOUBLE) * (x + y) + z % 7" if trend else "z"
    inner = f"SELECT CAST(l_orderkey % {width} AS INT) AS x, CAST((l_orderkey // {width} + l_linenumber * 7) % {width} AS INT) AS y, CAST(SUM(CAST(l_quantity AS BIGINT)) % 97 AS DOUBLE) AS z FROM lineitem GROUP BY 1, 2"
    return f"{name} AS MATERIALIZED (SELECT x, y, {z} AS z FROM ({inner}))"


STEPS = "steps(n, dx, dy, run, len) AS (VALUES (1,-1,0,1.0::DOUBLE,0.5::DOUBLE),(2,-1,-1,sqrt(2.0),0.354),(3,0,-1,1.0,0.5),(4,1,-1,sqrt(2.0),0.354),(5,1,0,1.0,0.5),(6,1,1,sqrt(2.0),0.354),(7,0,1,1.0,0.5),(8,-1,1,sqrt(2.0),0.354))"


def around(width: int = 64, source: str = "dem") -> str:
    """near: each cell with each of its neighbours on the grid; nz is null for NoData."""
    return f"near AS MATERIALIZED (SELECT q.x, q.y, q.z, n, run, len, q.x + dx AS nx, q.y + dy AS ny, b.z AS nz FROM {source} q CROSS JOIN steps LEFT JOIN {source} b ON b.x = q.x + dx AND b.y = q.y + dy WHERE q.x + dx BETWEEN 0 AND {width - 1} AND q.y + dy BETWEEN 0 AND {width - 1})"


def stencil(width: int = 64) -> str:
    """st: the cell as e and its neighbours as a..i, missing ones as the cell itself."""
    names = {2: "a", 3: "b", 4: "c", 1: "d", 5: "f", 8: "g", 7: "h", 6: "i"}
    picks = ", ".join(f"coalesce(max(nz) FILTER (n = {k}), z) AS {v}" for k, v in names.items())
    s = f"st AS (SELECT x, y, z AS e, {picks} FROM near GROUP BY x, y, z)"
    slopes = "sl AS (SELECT *, ((c+2*f+i)-(a+2*d+g))/8 AS dzdx, ((g+2*h+i)-(a+2*b+c))/8 AS dzdy, (d+f)/2-e AS cd, (b+h)/2-e AS ce, (-a+c+g-i)/4 AS cf, (-d+f)/2 AS cg, (b-h)/2 AS ch FROM st)"
    return f"{dem(width)}, {STEPS}, {around(width)}, {s}, {slopes}"


def inner(width: int = 64) -> str:
    return f"x > 0 AND y > 0 AND x < {width - 1} AND y < {width - 1}"


def edges(method: str, width: int = 64, exponent: float = 1.0) -> str:
    """edges AS (x, y, n, nx, ny, p) of a flow metric, with what it needs before."""
    head = f"{dem(width)}, {STEPS}, {around(width)}"
    lower = f"lower_ AS (SELECT * FROM near WHERE nz < z AND {inner(width)})"
    if method in ("d8", "d4"):
        which = "" if method == "d8" else "WHERE n % 2 = 1"
        return f"{head}, {lower}, edges AS MATERIALIZED (SELECT x, y, n, nx, ny, 1.0::DOUBLE AS p FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY nz, n) AS r FROM lower_ {which}) WHERE r = 1)"
    if method == "dinf":
        facets = "facets(k, s, d) AS (VALUES (1,1,2),(2,3,2),(3,3,4),(4,5,4),(5,5,6),(6,7,6),(7,7,8),(8,1,8))"
        both = f"pairs AS (SELECT a.x, a.y, k, s, d, a.z - a.nz AS s1, a.nz - b.nz AS s2, a.z - b.nz AS sd, atan2(a.nz - b.nz, a.z - a.nz) AS r0 FROM facets JOIN near a ON a.n = s JOIN near b ON b.n = d AND b.x = a.x AND b.y = a.y WHERE a.nz IS NOT NULL AND b.nz IS NOT NULL AND a.x > 0 AND a.y > 0 AND a.x < {width - 1} AND a.y < {width - 1})"
        steep = "steep AS (SELECT x, y, k, s, d, CASE WHEN r0 < 1e-7 THEN 0 WHEN r0 > pi()/4 - 1e-7 THEN pi()/4 ELSE r0 END AS r, CASE WHEN r0 < 1e-7 THEN s1 WHEN r0 > pi()/4 - 1e-7 THEN sd / sqrt(2.0) ELSE sqrt(s1*s1 + s2*s2) END AS slope FROM pairs)"
        best = "best AS (SELECT *, CASE WHEN r = 0 THEN 1.0 WHEN r = pi()/4 THEN 0.0 ELSE r / (pi()/4) END AS part FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY slope DESC, k) AS rn FROM steep WHERE slope > 0) WHERE rn = 1)"
        shares = "shares AS (SELECT x, y, s AS n, part AS p FROM best UNION ALL SELECT x, y, d, 1 - part FROM best)"
        return f"{head}, {facets}, {both}, {steep}, {best}, {shares}, edges AS MATERIALIZED (SELECT x, y, n, x + dx AS nx, y + dy AS ny, p::DOUBLE AS p FROM shares JOIN steps USING (n) WHERE p > 0)"
    weight = f"pow((z - nz) / run{' * len' if method != 'freeman' else ''}, {exponent}::DOUBLE)"
    return f"{head}, {lower}, edges AS MATERIALIZED (SELECT x, y, n, nx, ny, {weight} / sum({weight}) OVER (PARTITION BY x, y) AS p FROM lower_)"


def accumulated(weight: str = "1.0::DOUBLE", source: str = "dem") -> str:
    """acc AS (x, y, a): waves of flow down the edges, added up."""
    waves = f"waves AS (SELECT 0 AS k, x, y, {weight} AS f FROM {source} WHERE z IS NOT NULL UNION ALL SELECT k + 1, nx, ny, sum(f * p) FROM waves JOIN edges USING (x, y) GROUP BY k, nx, ny)"
    return f"{waves}, acc AS (SELECT x, y, sum(f) AS a FROM waves GROUP BY x, y)"


def filled(width: int = 64, neighbours: int = 8, source: str = "dem") -> str:
    """fill AS (x, y, w): from the outlets inwards, each cell the least it can be reached at."""
    odd = "AND n % 2 = 1" if neighbours == 4 else ""
    outlets = f"SELECT DISTINCT x, y, z AS w FROM {source} WHERE z IS NOT NULL AND (NOT ({inner(width)}) OR (x, y) IN (SELECT (x, y) FROM near WHERE nz IS NULL {odd}))"
    return f"fill(x, y, w) USING KEY (x, y) AS ({outlets} UNION SELECT nx, ny, min(greatest(nz, fill.w)) FROM fill JOIN near USING (x, y) LEFT JOIN recurring.fill old ON old.x = nx AND old.y = ny WHERE nz IS NOT NULL {odd} AND (old.w IS NULL OR greatest(nz, fill.w) < old.w) GROUP BY nx, ny)"


def edge_code(width: int = 64) -> str:
    m = width - 1
    return f"CASE WHEN x=0 AND y=0 THEN 2 WHEN x=0 AND y={m} THEN 8 WHEN x={m} AND y=0 THEN 4 WHEN x={m} AND y={m} THEN 6 WHEN x=0 THEN 1 WHEN x={m} THEN 5 WHEN y=0 THEN 3 WHEN y={m} THEN 7 END"


def directions(width: int = 64, trend: int = 0) -> str:
    """dirs AS (x, y, z): d8 directions, straight ones before diagonal ones."""
    head = f"{dem(width, trend)}, {STEPS}, {around(width)}"
    low = f"low AS (SELECT x, y, min(n) AS first, min(n) FILTER (n % 2 = 1) AS straight FROM (SELECT *, min(coalesce(nz, -1e30)) OVER (PARTITION BY x, y) AS m FROM near WHERE {inner(width)}) WHERE coalesce(nz, -1e30) = m AND m < z GROUP BY x, y)"
    return f"{head}, {low}, dirs AS MATERIALIZED (SELECT x, y, coalesce({edge_code(width)}, straight, first, 0)::DOUBLE AS z FROM dem LEFT JOIN low USING (x, y))"


def dinf(width: int = 64) -> str:
    """angles AS (x, y, z)."""
    facets = "facets(k, s, d, af, ac) AS (VALUES (0,5,4,1,0),(1,3,4,-1,1),(2,3,2,1,1),(3,1,2,-1,2),(4,1,8,1,2),(5,7,8,-1,3),(6,7,6,1,3),(7,5,6,-1,4))"
    pairs = f"pairs AS (SELECT a.x, a.y, k, af, ac, a.z - e1 AS s1, e1 - e2 AS s2, a.z - e2 AS sd, atan2(e1 - e2, a.z - e1) AS r0 FROM (SELECT a.x, a.y, a.z, k, af, ac, coalesce(a.nz, -1e30) AS e1, coalesce(b.nz, -1e30) AS e2 FROM facets JOIN near a ON a.n = s JOIN near b ON b.n = d AND b.x = a.x AND b.y = a.y) a WHERE {inner(width).replace('x ', 'a.x ').replace('y ', 'a.y ')})"
    best = "best AS (SELECT x, y, af * least(greatest(r0, 0), pi()/4) + ac * pi()/2 AS angle FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY slope DESC, k) AS rn FROM (SELECT *, CASE WHEN r0 < 0 THEN s1 WHEN r0 > pi()/4 THEN sd / sqrt(2.0) ELSE sqrt(s1*s1+s2*s2) END AS slope FROM pairs) WHERE slope > 0) WHERE rn = 1)"
    out = "CASE code WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 WHEN 5 THEN 0 WHEN 6 THEN 7 WHEN 7 THEN 6 WHEN 8 THEN 5 END * pi()/4"
    return f"{dem(width)}, {STEPS}, {around(width)}, {facets}, {pairs}, {best}, angles AS MATERIALIZED (SELECT x, y, coalesce({out}, angle, 0.0) AS z FROM (SELECT x, y, {edge_code(width)} AS code FROM dem) LEFT JOIN best USING (x, y))"


def _d8_edges(width: int, onto_data: bool = True) -> str:
    data = "AND (x + dx, y + dy) IN (SELECT (x, y) FROM dem)" if onto_data else ""
    return f"edges AS MATERIALIZED (SELECT x, y, x + dx AS nx, y + dy AS ny, 1.0::DOUBLE AS p FROM dirs JOIN steps ON n = z WHERE x + dx BETWEEN 0 AND {width - 1} AND y + dy BETWEEN 0 AND {width - 1} {data})"


def _attribute(expr: str, name: str, width: int = 64) -> str:
    return f"WITH {stencil(width)} SELECT x, y, round({expr}, 6) + 0.0 AS {name} FROM sl"


_RISE = "sqrt(dzdx*dzdx + dzdy*dzdy)"
_THETA = "degrees(atan2(dzdy, 0.0 - dzdx))"
ATTRIBUTES = {
    "slope_riserun": _RISE,
    "slope_percentage": f"{_RISE} * 100",
    "slope_degrees": f"degrees(atan({_RISE}))",
    "slope_radians": f"atan({_RISE})",
    "aspect": f"CASE WHEN dzdx = 0 AND dzdy = 0 THEN 270 WHEN {_THETA} > 90 THEN 450 - {_THETA} ELSE 90 - {_THETA} END",
    "curvature": "-2 * (cd + ce) * 100",
    "planform_curvature": "CASE WHEN cg = 0 AND ch = 0 THEN 0 ELSE -2 * (cd*ch*ch + ce*cg*cg - cf*cg*ch) / (cg*cg + ch*ch) * 100 END",
    "profile_curvature": "CASE WHEN cg = 0 AND ch = 0 THEN 0 ELSE 2 * (cd*cg*cg + ce*ch*ch + cf*cg*ch) / (cg*cg + ch*ch) * 100 END",
}
_FLAT = f"flat AS MATERIALIZED (SELECT dem.x, dem.y, dem.z, (CASE WHEN {inner(64).replace('x ', 'dem.x ').replace('y ', 'dem.y ')} AND NOT coalesce(bool_or(nz < near.z OR nz IS NULL), FALSE) THEN 1.0 ELSE 0.0 END)::DOUBLE AS flat FROM dem JOIN near USING (x, y) GROUP BY dem.x, dem.y, dem.z)"
#: A DEM with plateaus: heights in coarse steps.
_COARSE = f"{dem(64, name='fine')}, dem AS MATERIALIZED (SELECT x, y, floor(z / 40) AS z FROM fine)"
_FLATS = f"{_COARSE}, {STEPS}, {around()}, {_FLAT}"
_PAIRS = "pairs AS (SELECT near.*, a.flat, b.flat AS nflat FROM near JOIN flat a USING (x, y) JOIN flat b ON b.x = nx AND b.y = ny)"
_EDGE_KINDS = "kinds AS MATERIALIZED (SELECT x, y, max(CASE WHEN flat = 0 AND nflat = 1 AND nz = z THEN 1 WHEN flat = 1 AND z < nz THEN 2 END) AS kind FROM pairs GROUP BY x, y)"
_LABELS = "label(x, y, l) USING KEY (x, y) AS (SELECT x, y, (y * 64 + x)::BIGINT AS l FROM dem UNION SELECT nx, ny, min(label.l) FROM label JOIN near USING (x, y) JOIN recurring.label old ON old.x = nx AND old.y = ny WHERE nz = z AND label.l < old.l GROUP BY nx, ny)"

SQL: dict[str, str] = {
    "dem": f"WITH {dem()} SELECT x, y, z FROM dem",
    "hist": f"WITH {dem()} SELECT z, count(*)::BIGINT AS n FROM dem GROUP BY z",
    "min_max_count": f"WITH {dem(128)} SELECT min(z) AS min_z, max(z) AS max_z, count(z)::BIGINT AS n_data FROM dem",
    "count_value": f"WITH {dem()} SELECT count(*)::BIGINT AS n FROM dem WHERE z = 7",
    "replace": f"WITH {dem()} SELECT x, y, CASE WHEN z = 7 THEN -7.0 ELSE z END AS z FROM dem",
    "scale": f"WITH {dem()} SELECT x, y, z * 2.5 AS z FROM dem",
    "set_no_data": f"WITH {dem()} SELECT x, y, nullif(z, 7.0) AS z FROM dem",
    "flip_vert": f"WITH {dem()} SELECT x, (63 - y)::INT AS y, z FROM dem",
    "flip_horz": f"WITH {dem()} SELECT (63 - x)::INT AS x, y, z FROM dem",
    "transpose": f"WITH {dem()} SELECT y AS x, x AS y, z FROM dem",
    "crop": f"WITH {dem()} SELECT (x - 10)::INT AS x, (y - 20)::INT AS y, z FROM dem WHERE x BETWEEN 10 AND 29 AND y BETWEEN 20 AND 34",
    "expand": f"WITH {dem()} SELECT gx::INT AS x, gy::INT AS y, CASE WHEN dem.x IS NULL THEN -1e0 ELSE z END AS z FROM range(80) a(gx) CROSS JOIN range(70) b(gy) LEFT JOIN dem ON dem.x = gx AND dem.y = gy",
    "edge_cells": f"WITH {dem()} SELECT x, y, (y * 64 + x)::BIGINT AS i, x IN (0, 63) AND y IN (0, 63) AS corner FROM dem WHERE NOT ({inner()})",
    "set_edges": f"WITH {dem()} SELECT x, y, CASE WHEN {inner()} THEN z ELSE -5.0 END AS z FROM dem",
    "row_col_vectors": f"WITH {dem()} SELECT 'row' AS kind, array_to_string(list(z::INT ORDER BY x), ',') AS values FROM dem WHERE y = 5 UNION ALL SELECT 'col', array_to_string(list(z::INT ORDER BY y), ',') FROM dem WHERE x = 9",
    "compare_diff": f"WITH {dem()} SELECT x, y, z AS \"left\", z * 2 AS \"right\" FROM dem WHERE z > 90",
    "diff_stats": f"WITH {dem()} SELECT count(*)::BIGINT AS n, min(d) AS min_diff, max(d) AS max_diff, round(avg(d), 6) AS mean_diff, round(sqrt(avg(d * d)), 6) AS rms_diff FROM (SELECT z - z * z AS d FROM dem)",
    "geo": f"WITH {dem()} SELECT x, y, 100e0 + x * 2e0 AS gx, 50e0 - y * 3e0 AS gy FROM dem",
    "surface_area": f"WITH {stencil()}, tri(dn, dnz, sn, lx, ly) AS (VALUES (1,'a','d',1,1)) SELECT round(sum(total), 4) AS area, count(*)::DOUBLE AS planar_area FROM (SELECT x, y, " + " + ".join(f"sqrt(greatest((p{k}+q{k}+r{k})/2*((p{k}+q{k}+r{k})/2-p{k})*((p{k}+q{k}+r{k})/2-q{k})*((p{k}+q{k}+r{k})/2-r{k}),0))" for k in range(8)) + " AS total FROM (SELECT x, y, " + ", ".join(f"sqrt(2+pow({dn}-e,2))/2 AS p{k}, sqrt(1+pow({sn}-e,2))/2 AS q{k}, sqrt(1+pow({sn}-{dn},2))/2 AS r{k}" for k, (dn, sn) in enumerate([("a", "d"), ("a", "b"), ("c", "b"), ("c", "f"), ("i", "f"), ("i", "h"), ("g", "h"), ("g", "d")])) + " FROM st))",
    "perimeter_edge": f"WITH {dem(128)}, {STEPS} SELECT count(*)::DOUBLE AS perimeter FROM dem q CROSS JOIN steps LEFT JOIN dem b ON b.x = q.x + dx AND b.y = q.y + dy WHERE n % 2 = 1 AND b.z IS NULL",
    "perimeter_count": f"WITH {dem(128)} SELECT count(*)::DOUBLE AS perimeter FROM dem WHERE NOT ({inner(128)})",
    "d8_flowdirs": f"WITH {directions()} SELECT x, y, z FROM dirs",
    "d8_flowdirs_holes": f"WITH {directions(128)} SELECT x, y, z FROM dirs",
    "dinf_flowdirs": f"WITH {dinf()} SELECT x, y, round(z, 6) + 0.0 AS z FROM angles",
    "arcgis_codes": f"WITH {directions()} SELECT x, y, z, CASE WHEN z = 0 THEN 0.0 ELSE pow(2, (z + 3) % 8) END AS arcgis FROM dirs",
    "taudem_codes": f"WITH {dem()} SELECT x, y, CASE (x + y) % 9 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 1 WHEN 6 THEN 8 WHEN 7 THEN 7 ELSE 6 END::DOUBLE AS z FROM dem",
    "fa_weighted": f"WITH RECURSIVE {edges('d8')}, {accumulated('z')} SELECT x, y, round(a, 6) AS a FROM acc",
    "d8_area": f"WITH RECURSIVE {directions(64, 10)}, {_d8_edges(64)}, {accumulated()} SELECT x, y, a FROM acc",
    "dinf_area": f"WITH RECURSIVE {dinf()}, turns AS (SELECT x, y, z / (pi()/4) AS t FROM angles WHERE z <> 0), shares AS (SELECT x, y, round(t)::INT AS k, 1.0 AS p FROM turns WHERE abs(t - floor(t)) < 1e-6 UNION ALL SELECT x, y, floor(t)::INT + 1, floor(t) + 1 - t FROM turns WHERE abs(t - floor(t)) >= 1e-6 UNION ALL SELECT x, y, floor(t)::INT, t - floor(t) FROM turns WHERE abs(t - floor(t)) >= 1e-6), eighths(k, dx, dy) AS (VALUES (0,1,0),(1,1,-1),(2,0,-1),(3,-1,-1),(4,-1,0),(5,-1,1),(6,0,1),(7,1,1),(8,1,0)), edges AS MATERIALIZED (SELECT x, y, x + dx AS nx, y + dy AS ny, p FROM shares JOIN eighths USING (k) WHERE x + dx BETWEEN 0 AND 63 AND y + dy BETWEEN 0 AND 63), {accumulated(source='angles')} SELECT acc.x, acc.y, CASE WHEN z = 0 AND (acc.x, acc.y) NOT IN (SELECT (nx, ny) FROM edges) THEN 0.0 ELSE round(a, 6) END AS a FROM acc JOIN angles USING (x, y)",
    "upslope": f"WITH RECURSIVE {directions(64, 10)}, {_d8_edges(64, False)}, line AS (SELECT x, 40 AS y FROM range(30, 51) t(x)), up AS (SELECT x, y FROM line UNION SELECT e.x, e.y FROM up JOIN edges e ON e.nx = up.x AND e.ny = up.y) SELECT dem.x, dem.y, CASE WHEN line.x IS NOT NULL THEN 2e0 WHEN up.x IS NOT NULL THEN 1e0 END AS z FROM dem LEFT JOIN up USING (x, y) LEFT JOIN line USING (x, y)",
    "spi": f"WITH RECURSIVE {edges('d8')}, {accumulated()}, st AS (SELECT x, y, " + ", ".join(f"coalesce(max(nz) FILTER (n = {k}), z) AS {v}" for k, v in {2: 'a', 3: 'b', 4: 'c', 1: 'd', 5: 'f', 8: 'g', 7: 'h', 6: 'i'}.items()) + " FROM near GROUP BY x, y, z) SELECT x, y, round(ln(acc.a * (sqrt(pow(((c+2*f+i)-(st.a+2*d+g))/8, 2) + pow(((g+2*h+i)-(st.a+2*b+c))/8, 2)) + 0.001)), 6) + 0.0 AS z FROM acc JOIN st USING (x, y)",
    "cti": f"WITH RECURSIVE {edges('d8')}, {accumulated()}, st AS (SELECT x, y, " + ", ".join(f"coalesce(max(nz) FILTER (n = {k}), z) AS {v}" for k, v in {2: 'a', 3: 'b', 4: 'c', 1: 'd', 5: 'f', 8: 'g', 7: 'h', 6: 'i'}.items()) + " FROM near GROUP BY x, y, z) SELECT x, y, round(ln(acc.a / (sqrt(pow(((c+2*f+i)-(st.a+2*d+g))/8, 2) + pow(((g+2*h+i)-(st.a+2*b+c))/8, 2)) + 0.001)), 6) + 0.0 AS z FROM acc JOIN st USING (x, y)",
    "find_flats": f"WITH {_FLATS} SELECT x, y, flat AS z FROM flat",
    "flat_edges": f"WITH {_FLATS}, {_PAIRS}, {_EDGE_KINDS} SELECT x, y, kind::INT AS kind FROM kinds WHERE kind IS NOT NULL",
    "flat_labels": f"WITH RECURSIVE {_FLATS}, {_PAIRS}, {_EDGE_KINDS}, {_LABELS} SELECT x, y, l::DOUBLE AS z FROM label WHERE l IN (SELECT l FROM label JOIN kinds USING (x, y) WHERE kind = 1)",
    "fill_d8": f"WITH RECURSIVE {dem()}, {STEPS}, {around()}, {filled()} SELECT x, y, w AS z FROM fill",
    "fill_d4": f"WITH RECURSIVE {dem()}, {STEPS}, {around()}, {filled(neighbours=4)} SELECT x, y, w AS z FROM fill",
    "fill_holes": f"WITH RECURSIVE {dem(128)}, {STEPS}, {around(128)}, {filled(128)} SELECT x, y, w AS z FROM fill",
    "pit_mask": f"WITH RECURSIVE {dem()}, {STEPS}, {around()}, {filled()} SELECT x, y, (w > z)::INT::DOUBLE AS z FROM fill JOIN dem USING (x, y)",
    "has_depressions": f"WITH RECURSIVE {dem()}, {STEPS}, {around()}, {filled()} SELECT bool_or(w > z) AS has_depressions FROM fill JOIN dem USING (x, y)",
    "bucket_fill": f"WITH RECURSIVE {dem()}, {STEPS}, check_ AS MATERIALIZED (SELECT x, y, (z > 30)::INT AS z FROM dem), hit AS (SELECT x, y FROM check_ WHERE z = 1 AND NOT ({inner()}) UNION SELECT b.x, b.y FROM hit CROSS JOIN steps JOIN check_ b ON b.x = hit.x + dx AND b.y = hit.y + dy WHERE b.z = 1) SELECT dem.x, dem.y, CASE WHEN hit.x IS NULL THEN dem.z ELSE -1.0 END AS z FROM dem LEFT JOIN hit USING (x, y)",
    "mosaic": f"WITH {dem()} SELECT x, y, z FROM dem WHERE NOT (x >= 32 AND y >= 32)",
    "like_other": "SELECT x::INT AS x, y::INT AS y, 3.5::DOUBLE AS z FROM range(64) a(x) CROSS JOIN range(64) b(y)",
    "loop_check": "SELECT x::INT AS x, y::INT AS y FROM range(4) a(x) CROSS JOIN range(3) b(y)",
    "dh_seeds": f"WITH {dem()}, {STEPS}, {around()}, kinds AS (SELECT x, y, z, {inner()} AS land, bool_or(nz IS NOT NULL AND nx > 0 AND ny > 0 AND nx < 63 AND ny < 63) AS coast, bool_or(nz IS NULL OR nx = 0 OR ny = 0 OR nx = 63 OR ny = 63 OR nz < z) AS lower FROM near GROUP BY x, y, z) SELECT x, y, CASE WHEN land THEN 2 ELSE 1 END AS kind FROM kinds WHERE CASE WHEN land THEN NOT lower ELSE coast END",
}
SQL |= {name: _attribute(expr, name) for name, expr in ATTRIBUTES.items()}
SQL |= {f"{name}_holes": _attribute(ATTRIBUTES[name], name, 128) for name in ("slope_riserun", "curvature")}
_EXPONENTS = {"d8": 1.0, "d4": 1.0, "quinn": 1.0, "freeman": 1.1, "holmgren": 4.0, "dinf": 1.0}
SQL |= {f"fm_{m}": f"WITH {edges(m, 64, e)} SELECT x, y, n::INT AS n, nx::INT AS nx, ny::INT AS ny, round(p, 6) AS p FROM edges" for m, e in _EXPONENTS.items()}
SQL |= {f"fa_{m}": f"WITH RECURSIVE {edges(m, 64, e)}, {accumulated()} SELECT x, y, round(a, 6) AS a FROM acc" for m, e in _EXPONENTS.items()}
# the same over smaller tiles, so that cells lie on both sides of many borders
SQL |= {f"{name}_tiles": SQL[name] for name in ("fa_d8", "fa_freeman", "d8_area", "upslope", "fill_d8")}
# DEMs of several tiles of the usual size
SQL |= {f"{name}_wide": _attribute(ATTRIBUTES[name], name, 300) for name in ("slope_riserun", "profile_curvature")}
SQL |= {
    "d8_flowdirs_wide": f"WITH {directions(300)} SELECT x, y, z FROM dirs",
    "fm_quinn_wide": f"WITH {edges('quinn', 300, 1.0)} SELECT x, y, n::INT AS n, nx::INT AS nx, ny::INT AS ny, round(p, 6) AS p FROM edges",
}


def _steps(name: str, starts: str) -> str:
    """Fewest cells on a way from the starts through flat cells of one height."""
    return f"{name}(x, y, d) USING KEY (x, y) AS (SELECT x, y, 1::BIGINT AS d FROM kinds JOIN label USING (x, y) WHERE {starts} UNION SELECT p.nx, p.ny, min({name}.d) + 1 FROM {name} JOIN pairs p USING (x, y) LEFT JOIN recurring.{name} old ON old.x = p.nx AND old.y = p.ny WHERE p.nz = p.z AND p.nflat = 1 AND (old.d IS NULL OR {name}.d + 1 < old.d) GROUP BY p.nx, p.ny)"


_DRAINED = "drained AS MATERIALIZED (SELECT DISTINCT l FROM label JOIN kinds USING (x, y) WHERE kind = 1)"
_GRADIENTS = f"{_FLATS}, {_PAIRS}, {_EDGE_KINDS}, {_LABELS}, {_DRAINED}, {_steps('toward', 'kind = 1')}, {_steps('away', 'kind = 2 AND l IN (SELECT l FROM drained)')}, top AS (SELECT l, max(d) AS h FROM away JOIN label USING (x, y) GROUP BY l)"
SQL["flat_mask"] = f"WITH RECURSIVE {_GRADIENTS} SELECT label.x, label.y, (CASE WHEN t.d > 0 THEN coalesce(h - a.d, 0) + 2 * t.d ELSE -coalesce(a.d, 0) END)::INT AS mask, CASE WHEN label.l IN (SELECT l FROM drained) THEN label.l END AS label FROM label LEFT JOIN toward t USING (x, y) LEFT JOIN away a USING (x, y) LEFT JOIN top USING (l)"
SQL |= {f"{name}_tiles": SQL[name] for name in ("flat_mask", "flat_labels")}
