"""One function for each operation that users call by name; every one gives a new raster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions.hierarchy import Forest
from talus.operators import accumulate, flats, flood, flow, hierarchy, terrain
from talus.raster import Raster
from talus.sources import grids

NEIGHBOURS = {"D8": 8, "D4": 4}
#: Methods that need an exponent.
EXPONENT = ("Freeman", "Holmgren")


def _neighbours(topology: str) -> int:
    if topology not in NEIGHBOURS:
        raise ValueError(f"topology is one of {', '.join(NEIGHBOURS)}")
    return NEIGHBOURS[topology]


def _checked(method: str, exponent: float | None) -> None:
    if (method in EXPONENT) != (exponent is not None):
        raise ValueError(f"{' and '.join(EXPONENT)} need an exponent, other methods take none")


def FillDepressions(dem: Raster, epsilon: bool = False, topology: str = "D8") -> Raster:
    n = _neighbours(topology)
    return flood.fill_epsilon(dem, n) if epsilon else flood.fill(dem, n)


def BreachDepressions(dem: Raster, topology: str = "D8") -> Raster:
    return flood.breach(dem, "complete", _neighbours(topology))


def ResolveFlats(dem: Raster) -> Raster:
    return flats.resolve_epsilon(dem)


def FlowAccumulation(dem: Raster, method: str, exponent: float | None = None, weights: Raster | None = None) -> Raster:
    _checked(method, exponent)
    return accumulate.accumulation(dem, method, exponent, weights)


def FlowAccumFromProps(props: DataFrame, weights: Raster) -> Raster:
    """props: x, y, props with nine shares a cell, as from FlowProportions; weights: what each cell adds."""
    return accumulate.flow_accumulation(flow.edges_of_proportions(props), weights)


def FlowProportions(dem: Raster, method: str, exponent: float | None = None) -> DataFrame:
    _checked(method, exponent)
    return flow.proportions(dem, method, exponent)


def TerrainAttribute(dem: Raster, attrib: str, zscale: float = 1.0) -> Raster:
    return terrain.attribute(dem, attrib, zscale)


def generate_perlin_terrain(spark: SparkSession, size: int, seed: int = 0) -> Raster:
    return grids.perlin(spark, size, seed)


def get_new_depression_hierarchy_labels(spark: SparkSession, width: int, height: int) -> Raster:
    """Labels before anything is known: 1 everywhere; mark the ocean with 0."""
    return Raster.filled(spark, width, height, 1.0)


def _ocean(dem: Raster, labels: Raster) -> tuple[Raster, Column]:
    """The elevations with NoData where the labels say ocean: NoData is ocean."""
    dem._same_size(labels)
    sea = labels.cells.where("z = 0").select("x", "y", F.lit(True).alias("sea"))
    return dem.with_cells(dem.cells.join(sea, ["x", "y"], "left").select("x", "y", F.when(F.col("sea").isNull(), F.col("z")).alias("z")), "ocean"), F.lit(False)


def get_depression_hierarchy(dem: Raster, labels: Raster, topology: str = "D8") -> tuple[Forest, Raster, Raster]:
    """The forest, the label of each cell, and the direction that it drains in."""
    land, sea = _ocean(dem, labels)
    grown, forest = hierarchy.hierarchy(land, sea, _neighbours(topology))
    pick = lambda c, what: dem.with_cells(grown.select("x", "y", F.col(c).cast("double").alias("z")), what)
    return forest, pick("label", "depression labels"), pick("direction", "directions")


def fill_spill_merge(dem: Raster, labels: Raster, water: Raster, topology: str = "D8") -> tuple[Raster, Forest]:
    """Standing water on each cell once it has moved, and the forest with its water."""
    land, sea = _ocean(dem, labels)
    return hierarchy.fill_spill_merge(land, water, sea, _neighbours(topology))


LoadGrid, SaveGrid = grids.read_ascii, grids.write_ascii


def rdShow(raster: Raster, x: int = 0, y: int = 0, width: int = 20, height: int = 20) -> str:
    return raster.show(x, y, width, height)
