"""Flow metrics as edges, flow directions, and code conversions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions import stencil
from talus.functions.topology import ARCGIS, DX, DY, TAUDEM
from talus.plans.halo import over_tiles, rows, shifted
from talus.raster import Raster

#: Names of metrics; those of a set need an exponent.
METRICS = ("Tarboton", "Dinfinity", "Quinn", "Holmgren", "Freeman", "FairfieldLeymarieD8", "FairfieldLeymarieD4", "Rho8", "Rho4", "OCallaghanD8", "OCallaghanD4", "D8", "D4")
NEED_EXPONENT = {"Holmgren", "Freeman"}
EDGES = "x int, y int, n int, nx int, ny int, p double"


def _shares(method: str, exponent: float | None, seed: int):
    if method not in METRICS:
        raise ValueError(f"no such flow metric: {method}")
    if method in NEED_EXPONENT and exponent is None:
        raise ValueError(f"{method} needs an exponent")
    if method in ("Tarboton", "Dinfinity"):
        return lambda box, z: stencil.facets(z)
    if method in ("D8", "OCallaghanD8", "D4", "OCallaghanD4"):
        return lambda box, z: stencil.lowest(z, int(method[-1]))
    if method in ("Rho8", "FairfieldLeymarieD8", "Rho4", "FairfieldLeymarieD4"):
        return lambda box, z: stencil.randomised(z, box, int(method[-1]), seed)
    if method == "Quinn":
        return lambda box, z: stencil.spread(z, 1.0, contour=True)
    return lambda box, z: stencil.spread(z, exponent, contour=method == "Holmgren")


def edges(dem: Raster, method: str, exponent: float | None = None, seed: int = 0) -> DataFrame:
    """x, y, n, nx, ny, p: where the flow of each cell goes, shares adding up to 1. Cells on the grid's edge don't flow."""
    shares = _shares(method, exponent, seed)

    def kernel(box, present, z):
        p = shares(box, z)
        p[:, (box.outward() > 0) | ~present | np.isnan(shifted(z, 0, 0))] = 0
        n, y, x = np.nonzero(p[1:])
        n = n + 1
        x, y = x + box.x0, y + box.y0
        return {"x": x, "y": y, "n": n, "nx": x + np.array(DX)[n], "ny": y + np.array(DY)[n], "p": p[n, y - box.y0, x - box.x0]}

    return over_tiles(dem, kernel, EDGES)


def proportions(dem: Raster, method: str, exponent: float | None = None, seed: int = 0) -> DataFrame:
    """x, y, props: nine numbers; the first is 0 with flow, -1 without, -2 for NoData, the others the shares by code."""
    shares = _shares(method, exponent, seed)

    def kernel(box, present, z):
        p = shares(box, z)
        p[:, box.outward() > 0] = 0
        flag = np.where(np.isnan(shifted(z, 0, 0)), -2.0, np.where(p[1:].sum(axis=0) > 0, 0.0, -1.0))
        p[0] = flag
        return rows(box, present, **{f"p{k}": p[k] for k in range(9)})

    wide = over_tiles(dem, kernel, "x int, y int, " + ", ".join(f"p{k} double" for k in range(9)))
    return wide.select("x", "y", F.array(*[F.col(f"p{k}").cast("float") for k in range(9)]).alias("props"))


def edges_of_proportions(props: DataFrame) -> DataFrame:
    """Edges of a user's nine shares per cell."""
    step = lambda table: F.element_at(F.array(*[F.lit(v) for v in table]), F.col("n") + 1)
    each = props.select("x", "y", F.posexplode("props").alias("n", "p")).where("n > 0 AND p > 0")
    return each.select("x", "y", "n", (F.col("x") + step(DX)).cast("int").alias("nx"), (F.col("y") + step(DY)).cast("int").alias("ny"), F.col("p").cast("double").alias("p"))


def d8_directions(dem: Raster) -> Raster:
    """Codes 1..8, 0 for none; null for NoData."""

    def kernel(box, present, z):
        return rows(box, present, z=np.where(np.isnan(shifted(z, 0, 0)), np.nan, stencil.d8_directions(z, box)))

    return dem.with_cells(over_tiles(dem, kernel, "x int, y int, z double"), "d8 flow directions", no_data=255)


def dinf_directions(dem: Raster) -> Raster:
    """Angles in [0, 2 pi), null for NoData."""

    def kernel(box, present, z):
        return rows(box, present, z=np.where(np.isnan(shifted(z, 0, 0)), np.nan, stencil.dinf_directions(z, box)))

    return dem.with_cells(over_tiles(dem, kernel, "x int, y int, z double"), "d-infinity flow directions", no_data=-1)


def edges_of_d8(directions: Raster) -> DataFrame:
    """One edge for each cell with a direction that stays on data."""
    n = F.col("z").cast("int")
    step = lambda table: F.element_at(F.array(*[F.lit(v) for v in table]), n + 1)
    e = directions.cells.where("z > 0").select("x", "y", n.alias("n"), (F.col("x") + step(DX)).cast("int").alias("nx"), (F.col("y") + step(DY)).cast("int").alias("ny"), F.lit(1.0).alias("p"))
    return e.where(directions.in_grid(F.col("nx"), F.col("ny")))


#: Steps of the eighths of a turn, counter-clockwise from the east, the ninth again the first.
_EIGHTHS = [(1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0)]


def edges_of_dinf(directions: Raster) -> DataFrame:
    """Edges to the two neighbours beside each angle; an angle of 0 counts as none."""
    turn = F.col("z") / (math.pi / 4)
    single = F.abs(turn - F.floor(turn)) < 1e-6
    low = F.floor(turn).cast("int")
    one = F.array(F.struct(F.round(turn).cast("int").alias("k"), F.lit(1.0).alias("p")))
    two = F.array(F.struct((low + 1).alias("k"), (low + 1 - turn).alias("p")), F.struct(low.alias("k"), (turn - low).alias("p")))
    step = lambda i: F.element_at(F.array(*[F.lit(e[i]) for e in _EIGHTHS]), F.col("e.k") + 1)
    each = directions.cells.where("z IS NOT NULL AND z <> 0").select("x", "y", F.explode(F.when(single, one).otherwise(two)).alias("e"))
    out = each.select("x", "y", F.col("e.k").alias("n"), (F.col("x") + step(0)).cast("int").alias("nx"), (F.col("y") + step(1)).cast("int").alias("ny"), F.col("e.p").alias("p"))
    return out.where(directions.in_grid(F.col("nx"), F.col("ny")))


def _mapped(code: Column, table: dict[int, int]) -> Column:
    pairs = F.create_map(*[F.lit(v) for n, other in table.items() for v in (other, n)])
    found = F.element_at(pairs, code.cast("int"))
    return F.when(code.isNull(), None).when(code == 0, 0).otherwise(F.coalesce(found, F.raise_error(F.concat(F.lit("no such direction code: "), code.cast("string"))).cast("int")))


def from_arcgis(directions: Raster) -> Raster:
    return directions.with_z(_mapped(F.col("z"), ARCGIS).cast("double"), "from powers of two")


def from_taudem(directions: Raster) -> Raster:
    return directions.with_z(_mapped(F.col("z"), TAUDEM).cast("double"), "from counter-clockwise codes")


def to_arcgis(directions: Raster) -> Raster:
    pairs = F.create_map(*[F.lit(v) for n, other in ARCGIS.items() for v in (n, other)])
    return directions.with_z(F.when(F.col("z") == 0, 0.0).otherwise(F.element_at(pairs, F.col("z").cast("int")).cast("double")), "to powers of two")
