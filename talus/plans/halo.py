"""Focal plans: tiles with a halo, one shuffle.

A cell goes to the tile it lies in, and cells near a border also to the tiles
beyond it (under 2 % more rows at the usual tile size). A tile is a dense array
for a NumPy kernel, so a stencil costs one exchange of the raster, and all that
is computed from the same neighbourhood is computed at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.raster import Raster

TILE = 256


@dataclass(frozen=True)
class Box:
    """A tile: its place without the halo, the halo, and the grid's size."""

    x0: int
    y0: int
    width: int
    height: int
    pad: int
    grid_width: int
    grid_height: int

    def outward(self) -> np.ndarray:
        """The code that leads off the grid from each cell of the tile; 0 inside."""
        x = np.arange(self.x0, self.x0 + self.width)
        y = np.arange(self.y0, self.y0 + self.height)[:, None]
        west, east, north, south = x == 0, x == self.grid_width - 1, y == 0, y == self.grid_height - 1
        code = np.zeros((self.height, self.width), dtype=np.int8)
        for n, where in ((7, south), (3, north), (5, east), (1, west), (6, south & east), (4, north & east), (8, south & west), (2, north & west)):
            code[np.broadcast_to(where, code.shape)] = n
        return code

    def off_grid(self) -> np.ndarray:
        """Cells of the padded tile beyond the grid."""
        x = np.arange(self.x0 - self.pad, self.x0 + self.width + self.pad)
        y = np.arange(self.y0 - self.pad, self.y0 + self.height + self.pad)[:, None]
        return (x < 0) | (x >= self.grid_width) | (y < 0) | (y >= self.grid_height)


Kernel = Callable[..., dict[str, np.ndarray]]


def dealt(raster: Raster, tile: int, pad: int) -> DataFrame:
    """The cells with tx, ty of every tile that needs them."""

    def reach(c: str, size: int) -> Column:
        low, high = F.greatest(F.col(c) - pad, F.lit(0)), F.least(F.col(c) + pad, F.lit(size - 1))
        return F.sequence(F.floor(low / tile).cast("int"), F.floor(high / tile).cast("int"))

    wide = raster.cells.withColumn("tx", F.explode(reach("x", raster.meta.width)))
    return wide.withColumn("ty", F.explode(reach("y", raster.meta.height)))


def over_tiles(raster: Raster, kernel: Kernel, schema: str, bands: tuple[str, ...] = ("z",), pad: int = 1, tile: int = TILE) -> DataFrame:
    """kernel(box, present, *bands) gives the columns of its rows; bands are padded arrays with NaN for NoData.

    present marks the cells of the tile (without halo) that have a row.
    """
    w, h = raster.meta.width, raster.meta.height
    keep = list(dict.fromkeys(bands))
    fields = raster.cells.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tx, ty = key[0].as_py(), key[1].as_py()
        box = Box(tx * tile, ty * tile, min(tile, w - tx * tile), min(tile, h - ty * tile), pad, w, h)
        x = table.column("x").to_numpy() - box.x0 + pad
        y = table.column("y").to_numpy() - box.y0 + pad
        here = np.zeros((box.height + 2 * pad, box.width + 2 * pad), dtype=bool)
        inside = (x >= 0) & (y >= 0) & (x < here.shape[1]) & (y < here.shape[0])
        here[y[inside], x[inside]] = True
        arrays = []
        for name in keep:
            a = np.full(here.shape, np.nan)
            a[y[inside], x[inside]] = np.asarray(table.column(name).to_numpy(), dtype=np.float64)[inside]
            arrays.append(a)
        core = here[pad : pad + box.height, pad : pad + box.width]
        out = kernel(box, core, *arrays)
        return pa.table([pa.array(out[f.name], f.type, from_pandas=True) for f in arrow], schema=arrow)

    chosen = dealt(raster, tile, pad).select("tx", "ty", "x", "y", *[F.col(b).cast("double").alias(b) for b in keep])
    return chosen.groupBy("tx", "ty").applyInArrow(run, schema)


def rows(box: Box, where: np.ndarray, **columns: np.ndarray) -> dict[str, np.ndarray]:
    """x, y and the columns' values of the marked cells of a tile."""
    y, x = np.nonzero(where)
    return {"x": (x + box.x0).astype(np.int32), "y": (y + box.y0).astype(np.int32)} | {k: v[where] for k, v in columns.items()}


def shifted(a: np.ndarray, dx: int, dy: int, pad: int = 1) -> np.ndarray:
    """The neighbours of the inner cells in a direction."""
    h, w = a.shape
    return a[pad + dy : h - pad + dy, pad + dx : w - pad + dx]
