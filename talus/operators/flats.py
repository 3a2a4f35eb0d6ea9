"""Flats: finding them, making them drain, and directions within them.

Finding flats and their edges is focal, in tiles. Flats and the gradients in
them run across tiles: groups by components, gradients in rounds of tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions import flats as kernels
from talus.functions import stencil
from talus.functions.topology import DX, DY
from talus.operators import flow
from talus.operators.accumulate import distances
from talus.plans.checkpoints import cut
from talus.plans.components import components
from talus.plans.halo import TILE, over_tiles, rows, shifted
from talus.raster import Raster


def find_flats(dem: Raster) -> Raster:
    """1 in a flat, 0 outside and on the grid's edge, NoData kept."""
    def kernel(box, present, z):
        return rows(box, present, z=stencil.flats(z, box.off_grid()))

    return dem.with_cells(over_tiles(dem, kernel, "x int, y int, z double"), "find flats", no_data=-1)


def flat_edges(dem: Raster) -> DataFrame:
    """x, y, kind: 1 where a flat drains, 2 where higher ground meets it."""

    def kernel(box, present, z):
        off = box.off_grid()
        flat = stencil.flats(z, off)  # of the tile and one cell around
        flat[off[1:-1, 1:-1]] = np.nan
        inner = z[1:-1, 1:-1]
        kind = kernels.edge_kinds(inner, flat)
        return rows(box, present & (kind > 0), kind=kind)

    return over_tiles(dem, kernel, "x int, y int, kind int", pad=2)


def _ground(dem: Raster, tile: int) -> DataFrame:
    """x, y, kind (as in flat_edges), part: the first cell's flat id of the cells in the tile that equal heights join it to."""
    width = dem.meta.width

    def kernel(box, present, z):
        off = box.off_grid()
        flat = stencil.flats(z, off)
        flat[off[1:-1, 1:-1]] = np.nan
        y, x = np.divmod(kernels.equal_groups(z[2:-2, 2:-2]), box.width)
        return rows(box, present, kind=kernels.edge_kinds(z[1:-1, 1:-1], flat), part=(y + box.y0).astype(np.int64) * width + x + box.x0)

    return over_tiles(dem, kernel, "x int, y int, kind int, part long", pad=2, tile=tile)


def _level_steps(dem: Raster, tile: int) -> DataFrame:
    """x, y, nx, ny, way: steps to cells of equal height that are flat (0), or that lie in another tile, each pair once (1)."""

    def kernel(box, present, z):
        off = box.off_grid()
        flat = stencil.flats(z, off)
        flat[off[1:-1, 1:-1]] = np.nan
        inner, parts = z[1:-1, 1:-1], []
        own = shifted(inner, 0, 0)
        y, x = np.indices(own.shape)
        for n in range(1, 9):
            level = present & (shifted(inner, DX[n], DY[n]) == own)
            beyond = (x + DX[n] < 0) | (y + DY[n] < 0) | (x + DX[n] >= box.width) | (y + DY[n] >= box.height)
            for way, where in ((0, level & (shifted(flat, DX[n], DY[n]) == 1)), (1, level & beyond & (n > 4))):
                sy, sx = np.nonzero(where)
                parts.append((sx + box.x0, sy + box.y0, sx + box.x0 + DX[n], sy + box.y0 + DY[n], np.full(len(sx), way)))
        x, y, nx, ny, way = (np.concatenate(p) for p in zip(*parts))
        return {"x": x, "y": y, "nx": nx, "ny": ny, "way": way}

    return over_tiles(dem, kernel, "x int, y int, nx int, ny int, way int", pad=2, tile=tile)


def flat_mask(dem: Raster, tile: int = TILE) -> DataFrame:
    """x, y, mask (increments towards drainage, 0 outside flats), label (flat id of the first cell of the group; null if none drains).

    Groups are joined across tiles by components of the tiles' own groups, and steps are counted from tile to tile.
    """
    width = dem.meta.width
    cells, steps = cut(_ground(dem, tile)), cut(_level_steps(dem, tile))
    at = lambda x, y, name: cells.select(F.col("x").alias(x), F.col("y").alias(y), F.col("part").alias(name))
    pairs = steps.where("way = 1").join(at("x", "y", "a"), ["x", "y"]).join(at("nx", "ny", "b"), ["nx", "ny"]).select("a", "b")
    whole = cells.join(components(pairs), cells["part"] == F.col("node"), "left").select("x", "y", "kind", F.coalesce("component", "part").alias("label"))
    drained = whole.where("kind = 1").select("label").distinct().withColumn("drained", F.lit(True))
    labelled = cut(whole.join(drained, "label", "left").select("x", "y", "kind", F.when(F.col("drained"), F.col("label")).alias("label")))
    links = steps.where("way = 0")
    towards = distances(links, labelled.where("kind = 1"), width, tile).withColumnRenamed("d", "towards")
    away = distances(links, labelled.where("kind = 2 AND label IS NOT NULL"), width, tile).withColumnRenamed("d", "away")
    known = labelled.join(towards, ["x", "y"], "left").join(away, ["x", "y"], "left")
    height = known.where("away > 0").groupBy("label").agg(F.max("away").alias("height"))
    own, lift = F.coalesce("away", F.lit(0)), F.coalesce(F.col("height") - F.col("away"), F.lit(0))
    mask = F.when(F.col("towards") > 0, lift + 2 * F.col("towards")).otherwise(-own)
    return known.join(height, "label", "left").select("x", "y", mask.cast("int").alias("mask"), "label")


def resolve_epsilon(dem: Raster) -> Raster:
    """Flats raised by the least amounts that make them drain."""

    def lift(z, by):
        return pd.Series(kernels.raised(np.nan_to_num(z.to_numpy(dtype=float)), by.to_numpy(dtype=np.int64)))

    lift.__annotations__ = {"z": pd.Series, "by": pd.Series, "return": pd.Series}
    lift = F.pandas_udf(lift, "double")

    both = dem.cells.join(flat_mask(dem), ["x", "y"])
    raise_it = F.col("z").isNotNull() & F.col("label").isNotNull() & ~dem.is_edge & (F.col("mask") > 0)
    cells = both.select("x", "y", F.when(raise_it, lift("z", "mask")).otherwise(F.col("z")).alias("z"))
    return dem.with_cells(cells, "resolve flats")


def _masked(dem: Raster, directions: Raster, pick) -> Raster:
    """Directions, with those of cells without one picked from the flat mask: pick(mask, label), both padded."""
    both = directions.cells.join(flat_mask(dem), ["x", "y"]).select("x", "y", "z", F.col("mask").cast("double").alias("mask"), F.coalesce(F.col("label").cast("double"), F.lit(-1.0)).alias("label"))

    def kernel(box, present, z, mask, label):
        own = shifted(z, 0, 0)
        inner = (own == 0) & (box.outward() == 0)
        return rows(box, present, z=np.where(inner, pick(mask, label), own))

    cells = over_tiles(Raster(both, directions.meta), kernel, "x int, y int, z double", bands=("z", "mask", "label"))
    return directions.with_cells(cells, "directions in flats")


def _pick_d8(mask: np.ndarray, label: np.ndarray) -> np.ndarray:
    e, n = stencil.around(mask)
    own, other = stencil.around(label)
    best, code = e.copy(), np.zeros(e.shape)
    with np.errstate(invalid="ignore"):
        for k in range(1, 9):
            better = (other[k] == own) & ((n[k] < best) | ((n[k] == best) & (code > 0) & (code % 2 == 0) & (k % 2 == 1)))
            best, code = np.where(better, n[k], best), np.where(better, k, code)
    return code


def _pick_dinf(mask: np.ndarray, label: np.ndarray) -> np.ndarray:
    e, n = stencil.around(mask)
    own, other = stencil.around(label)
    top, angle, found = np.zeros(e.shape), np.zeros(e.shape), np.zeros(e.shape, dtype=bool)
    order = [(5, 4, 1, 0), (3, 4, -1, 2), (3, 2, 1, 2), (1, 2, -1, 4), (1, 8, 1, 4), (7, 8, -1, 6), (7, 6, 1, 6), (5, 6, -1, 8)]
    q = stencil.QUARTER
    with np.errstate(invalid="ignore"):
        for straight, diagonal, way, base in order:
            s1, s2 = e - n[straight], n[straight] - n[diagonal]
            r = np.arctan2(s2, s1)
            s = np.where(r < 0, s1, np.where(r > q, (e - n[diagonal]) / np.sqrt(2), np.hypot(s1, s2)))
            better = (other[straight] == own) & (other[diagonal] == own) & (s > top)
            top, angle = np.where(better, s, top), np.where(better, way * np.clip(r, 0, q) + base * q, angle)
            found |= better
        for k in range(1, 9):  # else the first neighbour of the group that is lower
            lower = ~found & (other[k] == own) & (n[k] < e)
            angle = np.where(lower, stencil.EIGHTH[k] * q, angle)
            found |= lower
    return angle


def d8_with_flats(dem: Raster) -> Raster:
    return _masked(dem, flow.d8_directions(dem), _pick_d8)


def dinf_with_flats(dem: Raster) -> Raster:
    return _masked(dem, flow.dinf_directions(dem), _pick_dinf)


def flood_for_directions(dem: Raster) -> Raster:
    """Filled, then directed, flats included."""
    from talus.operators.flood import fill

    return d8_with_flats(fill(dem))
