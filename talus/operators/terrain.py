"""Terrain attributes, surface area and perimeter: one halo exchange each, however many attributes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions import stencil
from talus.functions.topology import DX, DY
from talus.plans.halo import over_tiles, rows, shifted
from talus.raster import Raster

ATTRIBUTES = ("slope_riserun", "slope_percentage", "slope_degrees", "slope_radians", "aspect", "curvature", "planform_curvature", "profile_curvature")


def attributes(dem: Raster, names: tuple[str, ...] = ATTRIBUTES, zscale: float = 1.0) -> DataFrame:
    """x, y and a column for each attribute of all cells with data, from one pass."""
    lx, ly = dem.meta.cell_length_x, dem.meta.cell_length_y
    wrong = set(names) - set(ATTRIBUTES)
    if wrong:
        raise ValueError(f"no such attribute: {sorted(wrong)}")

    def kernel(box, present, z):
        return rows(box, present & ~np.isnan(shifted(z, 0, 0)), **stencil.attributes(z, names, lx, ly, zscale))

    return over_tiles(dem, kernel, "x int, y int, " + ", ".join(f"{n} double" for n in names))


def attribute(dem: Raster, name: str, zscale: float = 1.0) -> Raster:
    return dem.with_cells(attributes(dem, (name,), zscale).withColumnRenamed(name, "z"), name)


def _joined(accumulation: Raster, slope: Raster) -> DataFrame:
    accumulation._same_size(slope)
    return accumulation.cells.select("x", "y", F.col("z").alias("a")).join(slope.cells.select("x", "y", F.col("z").alias("s")), ["x", "y"])


def stream_power(accumulation: Raster, slope: Raster) -> Raster:
    """ln(area * (slope + 0.001)); slope in rise over run."""
    cells = _joined(accumulation, slope).select("x", "y", F.log(F.col("a") / accumulation.meta.cell_area * (F.col("s") + 0.001)).alias("z"))
    return slope.with_cells(cells, "stream power index")


def wetness(accumulation: Raster, slope: Raster) -> Raster:
    """ln(area / (slope + 0.001)); slope in rise over run."""
    cells = _joined(accumulation, slope).select("x", "y", F.log(F.col("a") / accumulation.meta.cell_area / (F.col("s") + 0.001)).alias("z"))
    return slope.with_cells(cells, "compound topographic index")


def surface_area(dem: Raster, zscale: float = 1.0) -> DataFrame:
    """area, planar_area: one row. The area is never below the planar one."""
    lx, ly, cell = dem.meta.cell_length_x, dem.meta.cell_length_y, dem.meta.cell_area

    def kernel(box, present, z):
        return rows(box, present & ~np.isnan(shifted(z, 0, 0)), area=stencil.surface_area(z, lx, ly, zscale))

    total = over_tiles(dem, kernel, "x int, y int, area double").agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"), F.count("*").alias("n"))
    return total.select(F.greatest("area", F.col("n") * cell).alias("area"), (F.col("n") * cell).alias("planar_area"))


def perimeter(dem: Raster, kind: str = "square_edge") -> DataFrame:
    """perimeter: one row. cell_count: cells on the grid's edge; square_edge: lengths of sides that face NoData or the outside."""
    if kind not in ("square_edge", "cell_count"):
        raise ValueError("kind is square_edge or cell_count")
    lx, ly = dem.meta.cell_length_x, dem.meta.cell_length_y
    if kind == "cell_count":
        return dem.cells.where(F.col("z").isNotNull() & dem.is_edge).agg(F.count("*").cast("double").alias("perimeter"))

    def kernel(box, present, z):
        flat = sum(np.isnan(shifted(z, DX[n], DY[n])).astype(float) for n in (3, 7))
        upright = sum(np.isnan(shifted(z, DX[n], DY[n])).astype(float) for n in (1, 5))
        return rows(box, present & ~np.isnan(shifted(z, 0, 0)), length=flat * lx + upright * ly)

    return over_tiles(dem, kernel, "x int, y int, length double").agg(F.coalesce(F.sum("length"), F.lit(0.0)).alias("perimeter"))


def focal(dem: Raster, fn, what: str = "focal") -> Raster:
    """A user's function of nine arrays (the cell, then its neighbours by code; NaN for NoData) to one."""

    def kernel(box, present, z):
        e, n = stencil.around(z)
        return rows(box, present & ~np.isnan(e), z=fn(e, *n[1:]))

    return dem.with_cells(over_tiles(dem, kernel, "x int, y int, z double"), what)
