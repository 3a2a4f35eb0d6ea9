"""One query for each raster operator, over elevations derived from lineitem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators import accumulate, flats, flood, flow, hierarchy, terrain
from talus.plans.checkpoints import cut
from talus.raster import Raster
from talus.sources import grids
from talus.sources.datasets import dem

Query = Callable[[SparkSession, str], DataFrame]

#: Cells a side of a DEM in four tiles of the usual size.
WIDE = 300


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


def _cells(f: Callable[[Raster], Raster], width: int = 64, trend: int = 0) -> Query:
    return lambda spark, d: f(dem(spark, d, width, trend)).cells.select("x", "y", "z")


def _attribute(name: str, width: int = 64) -> Query:
    return lambda spark, d: _rounded(terrain.attributes(dem(spark, d, width), (name,)), name)


def _metric(method: str, exponent: float | None = None, width: int = 64) -> Query:
    return lambda spark, d: _rounded(flow.edges(dem(spark, d, width), method, exponent), "p")


def _accumulated(method: str, exponent: float | None = None) -> Query:
    return lambda spark, d: _rounded(accumulate.accumulation(dem(spark, d), method, exponent).cells.select("x", "y", F.col("z").alias("a")), "a")


def _expanded(spark, d):
    return dem(spark, d).expand(80, 70, -1.0).cells


def _edge_cells(spark, d):
    r = dem(spark, d)
    return r.cells.where(r.is_edge).select("x", "y", r.flat_id.alias("i"), r.is_corner.alias("corner"))


def _vectors(spark, d):
    r = dem(spark, d).map(lambda z: z.cast("int"))
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.array_join("values", ",").alias("values"))
    return named(r.row(5), "row").unionByName(named(r.col(9), "col"))


def _compared(spark, d):
    r = dem(spark, d)
    return r.differing(r.map(lambda z: F.when(z > 90, z * 2).otherwise(z)))


def _diff_stats(spark, d):
    r = dem(spark, d)
    return _rounded(r.diff_stats(r.map(lambda z: z * z)), "mean_diff", "rms_diff")


def _geo(spark, d):
    from dataclasses import replace

    r = dem(spark, d)
    gx, gy = replace(r.meta, geotransform=(100.0, 2.0, 0.0, 50.0, 0.0, -3.0)).to_geo(F.col("x"), F.col("y"))
    return r.cells.select("x", "y", gx.alias("gx"), gy.alias("gy"))


def _surface(spark, d):
    return terrain.surface_area(dem(spark, d)).select(F.round("area", 4).alias("area"), "planar_area")


def _arcgis(spark, d):
    r = flow.d8_directions(dem(spark, d))
    there = flow.to_arcgis(r)
    return flow.from_arcgis(there).cells.join(there.cells.withColumnRenamed("z", "arcgis"), ["x", "y"]).select("x", "y", "z", "arcgis")


def _taudem(spark, d):
    r = dem(spark, d)
    return flow.from_taudem(Raster(r.cells.withColumn("z", (F.col("x") + F.col("y")) % 9), r.meta)).cells


def _weighted(spark, d):
    r = dem(spark, d)
    return _rounded(accumulate.accumulation(r, "D8", weights=r).cells.select("x", "y", F.col("z").alias("a")), "a")


def _d8_area(spark, d):
    return accumulate.d8_area(flow.d8_directions(dem(spark, d, trend=10))).cells.select("x", "y", F.col("z").alias("a"))


def _d8_area_tiles(spark, d):
    return accumulate.d8_area(flow.d8_directions(dem(spark, d, trend=10)), tile=16).cells.select("x", "y", F.col("z").alias("a"))


def _dinf_area(spark, d):
    return _rounded(accumulate.dinf_area(flow.dinf_directions(dem(spark, d))).cells.select("x", "y", F.col("z").alias("a")), "a")


def _upslope(spark, d):
    return accumulate.upslope_cells(flow.d8_directions(dem(spark, d, trend=10)), 30, 40, 50, 40).cells.select("x", "y", "z")


def _upslope_tiles(spark, d):
    return accumulate.upslope_cells(flow.d8_directions(dem(spark, d, trend=10)), 30, 40, 50, 40, tile=16).cells.select("x", "y", "z")


def _loops(spark, d):
    """Twelve cells on a ring or running into it, beside cells that drain."""
    r = Raster.filled(spark, 6, 3, 3.0)
    ring = F.when(F.col("y") == 0, F.element_at(F.array(*[F.lit(v) for v in (5.0, 5.0, 5.0, 1.0, 3.0, 3.0)]), F.col("x") + 1)).otherwise(F.col("z"))
    return accumulate.loops(r.with_z(ring, "ring"))


def _index(index) -> Query:
    def run(spark, d):
        r = dem(spark, d)
        return _rounded(index(accumulate.accumulation(r, "D8"), terrain.attribute(r, "slope_riserun")).cells, "z")

    return run


def _coarse(spark, d) -> Raster:
    return dem(spark, d).map(lambda z: F.floor(z / 40).cast("double"))


def _has(spark, d):
    return spark.createDataFrame([(flood.has_depressions(dem(spark, d)),)], "has_depressions boolean")


def _bucket(spark, d):
    r = dem(spark, d)
    return accumulate.bucket_fill_from_edges(r.map(lambda z: (z > 30).cast("double")), r, 1.0, -1.0).cells


def _seeds(spark, d):
    r = dem(spark, d)
    return hierarchy.seeds(r, r.is_edge)


def _outlets(spark, d):
    r = dem(spark, d)
    return hierarchy.outlets(r, cut(hierarchy.basins(r, r.is_edge)))


def _depressions(spark, d):
    r = dem(spark, d)
    return _rounded(hierarchy.table(spark, hierarchy.hierarchy(r, r.is_edge)[1]), "volume")


def _rained(spark, d):
    r = dem(spark, d)
    return _rounded(hierarchy.fill_spill_merge(r, r.map(lambda z: F.lit(5.0)), r.is_edge)[0].cells, "z")


def _mosaic(spark, d):
    """Cuts the DEM into tiles, leaves one out, and puts them together again."""
    from talus.sources import layout

    r = dem(spark, d)
    parts = {(tx, ty): r.crop(tx * 32, ty * 32, 32, 32) for tx in range(2) for ty in range(2) if (tx, ty) != (1, 1)}
    return layout.mosaic(parts, 32, 32, 2, 2).cells.select("x", "y", "z")


QUERIES: dict[str, Query] = {
    "dem": _cells(lambda r: r),
    "hist": lambda s, d: dem(s, d).histogram(),
    "min_max_count": lambda s, d: dem(s, d, 128).stats(),
    "count_value": lambda s, d: dem(s, d).count_value(7.0),
    "replace": _cells(lambda r: r.replace(7.0, -7.0)),
    "scale": _cells(lambda r: r.scale(2.5)),
    "set_no_data": _cells(lambda r: r.set_no_data(7.0)),
    "flip_vert": _cells(lambda r: r.flip_vert()),
    "flip_horz": _cells(lambda r: r.flip_horz()),
    "transpose": _cells(lambda r: r.transpose()),
    "crop": _cells(lambda r: r.crop(10, 20, 20, 15)),
    "expand": _expanded,
    "edge_cells": _edge_cells,
    "set_edges": _cells(lambda r: r.set_edges(-5.0)),
    "row_col_vectors": _vectors,
    "compare_diff": _compared,
    "diff_stats": _diff_stats,
    "geo": _geo,
    **{name: _attribute(name) for name in terrain.ATTRIBUTES},
    "slope_riserun_holes": _attribute("slope_riserun", 128),
    "curvature_holes": _attribute("curvature", 128),
    "slope_riserun_wide": _attribute("slope_riserun", WIDE),
    "profile_curvature_wide": _attribute("profile_curvature", WIDE),
    "surface_area": _surface,
    "perimeter_edge": lambda s, d: terrain.perimeter(dem(s, d, 128), "square_edge"),
    "perimeter_count": lambda s, d: terrain.perimeter(dem(s, d, 128), "cell_count"),
    "fm_d8": _metric("D8"),
    "fm_d4": _metric("D4"),
    "fm_freeman": _metric("Freeman", 1.1),
    "fm_holmgren": _metric("Holmgren", 4.0),
    "fm_quinn": _metric("Quinn"),
    "fm_quinn_wide": _metric("Quinn", width=WIDE),
    "fm_dinf": _metric("Dinfinity"),
    "d8_flowdirs": _cells(flow.d8_directions),
    "d8_flowdirs_holes": _cells(flow.d8_directions, 128),
    "d8_flowdirs_wide": _cells(flow.d8_directions, WIDE),
    "dinf_flowdirs": lambda s, d: _rounded(flow.dinf_directions(dem(s, d)).cells, "z"),
    "arcgis_codes": _arcgis,
    "taudem_codes": _taudem,
    "fa_d8": _accumulated("D8"),
    "fa_d4": _accumulated("D4"),
    "fa_freeman": _accumulated("Freeman", 1.1),
    "fa_holmgren": _accumulated("Holmgren", 4.0),
    "fa_quinn": _accumulated("Quinn"),
    "fa_dinf": _accumulated("Dinfinity"),
    "fa_weighted": _weighted,
    "d8_area": _d8_area,
    "dinf_area": _dinf_area,
    "upslope": _upslope,
    "loop_check": _loops,
    "spi": _index(terrain.stream_power),
    "cti": _index(terrain.wetness),
    "find_flats": lambda s, d: flats.find_flats(_coarse(s, d)).cells,
    "flat_edges": lambda s, d: flats.flat_edges(_coarse(s, d)),
    "flat_labels": lambda s, d: flats.flat_mask(_coarse(s, d)).where("label IS NOT NULL").select("x", "y", F.col("label").cast("double").alias("z")),
    "flat_mask": lambda s, d: flats.flat_mask(_coarse(s, d)),
    "resolve_flats": lambda s, d: flats.resolve_epsilon(_coarse(s, d)).cells,
    "flat_flowdirs": lambda s, d: flats.d8_with_flats(_coarse(s, d)).cells,
    "dinf_flat_flowdirs": lambda s, d: flats.dinf_with_flats(_coarse(s, d)).cells,
    "fill_d8": _cells(flood.fill),
    "fill_d4": _cells(lambda r: flood.fill(r, 4)),
    "fill_holes": _cells(lambda r: flood.fill(r, tile=32), 128),
    "fill_epsilon": _cells(flood.fill_epsilon),
    "fill_up_to": _cells(lambda r: flood.fill_up_to(r, 3)),
    "pit_mask": _cells(flood.pit_mask),
    "has_depressions": _has,
    "flood_flowdirs": _cells(flood.flood_directions),
    "watersheds": _cells(flood.watersheds),
    "breach_complete": _cells(flood.breach),
    "breach_selective": _cells(lambda r: flood.breach(r, "selective", max_length=4, max_depth=20.0, fill=True)),
    "breach_constrained": _cells(lambda r: flood.breach(r, "constrained", max_length=4, max_depth=20.0)),
    "bucket_fill": _bucket,
    "mosaic": _mosaic,
    "like_other": _cells(lambda r: r.like(3.5)),
    "perlin": lambda s, d: _rounded(grids.perlin(s, 64, 7).cells, "z"),
    "dh_seeds": _seeds,
    "dh_outlets": _outlets,
    "dh_depressions": _depressions,
    "fill_spill_merge": _rained,
    "fa_d8_tiles": lambda s, d: _rounded(accumulate.accumulation(dem(s, d), "D8", tile=16).cells.select("x", "y", F.col("z").alias("a")), "a"),
    "fa_freeman_tiles": lambda s, d: _rounded(accumulate.accumulation(dem(s, d), "Freeman", 1.1, tile=16).cells.select("x", "y", F.col("z").alias("a")), "a"),
    "d8_area_tiles": _d8_area_tiles,
    "upslope_tiles": _upslope_tiles,
    "flat_mask_tiles": lambda s, d: flats.flat_mask(_coarse(s, d), tile=16),
    "flat_labels_tiles": lambda s, d: flats.flat_mask(_coarse(s, d), tile=16).where("label IS NOT NULL").select("x", "y", F.col("label").cast("double").alias("z")),
    "fill_d8_tiles": _cells(lambda r: flood.fill(r, tile=16)),
    "rho8": _metric("Rho8"),
    "rho4": _metric("Rho4"),
}
