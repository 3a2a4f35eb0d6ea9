"""Depression filling, masks, watersheds and breaching.

Filling works in two rounds over tiles. Each tile is flooded alone: cells that
surely drain have label 0, cells on the tile's border start labels of their own,
and the lowest passes between labels leave as a small graph. The graph (its size
goes with the borders, not the cells) gives each label the level it must rise
to; the second round applies that. The answer is unique, so tiles don't show.

Operators whose result hangs on the order of a queue run on the raster as one
group and refuse more than `MAX_ALONE` cells.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions import flood as kernels
from talus.functions.topology import DX, DY, codes
from talus.plans.checkpoints import cut
from talus.plans.halo import TILE, over_tiles, rows, shifted
from talus.raster import Raster

MAX_ALONE = 1 << 22
#: Passes between labels that the driver solves by itself; more are relaxed as a DataFrame.
MAX_PASSES = 2_000_000


def alone(raster: Raster, kernel, what: str, **changes) -> Raster:
    """kernel(array) of the whole raster as one group."""
    w, h = raster.meta.width, raster.meta.height
    if w * h > MAX_ALONE:
        raise ValueError(f"{what} handles the raster as one group, at most {MAX_ALONE} cells")

    def run(table: pa.Table) -> pa.Table:
        x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
        z = np.full((h, w), np.nan)
        z[y, x] = np.asarray(table.column("z").to_numpy(), dtype=float)
        return pa.table({"x": x, "y": y, "z": pa.array(kernel(z)[y, x].astype(float), from_pandas=True)})

    cells = raster.cells.select("x", "y", F.col("z").cast("double").alias("z"), F.lit(0).alias("g")).groupBy("g").applyInArrow(run, "x int, y int, z double")
    return raster.with_cells(cells, what, **changes)


def _round_one(dem: Raster, neighbours: int, tile: int) -> DataFrame:
    """x, y, z (filled within the tile), tx, ty, label; and the passes, as rows with a null x."""
    schema = "x int, y int, z double, tx int, ty int, a int, b int"

    def kernel(box, present, z):
        inner = shifted(z, 0, 0)
        edge = np.zeros(inner.shape, dtype=bool)
        edge[0] = edge[-1] = True
        edge[:, 0] = edge[:, -1] = True
        hole = np.isnan(z)
        drains = np.zeros(inner.shape, dtype=bool)
        for n in codes(neighbours):
            drains |= shifted(hole, DX[n], DY[n])  # NoData, and what is off the grid
        drains |= box.outward() > 0
        filled, label, passes = kernels.flood(inner, drains & ~np.isnan(inner), neighbours, edge)
        own = rows(box, present, z=filled, a=label)
        n, k = len(own["x"]), len(passes)
        return {
            "x": pa.array([*own["x"].tolist(), *[None] * k], pa.int32()),
            "y": pa.array([*own["y"].tolist(), *[None] * k], pa.int32()),
            "z": np.concatenate((own["z"], [v for _, _, v in passes])),
            "tx": np.full(n + k, box.x0 // tile), "ty": np.full(n + k, box.y0 // tile),
            "a": np.concatenate((own["a"], [a for a, _, _ in passes])).astype(np.int32), "b": np.concatenate((np.zeros(n), [b for _, b, _ in passes])).astype(np.int32),
        }

    return over_tiles(dem, kernel, schema, tile=tile)


def _name(a: str, tx: str = "tx", ty: str = "ty"):
    """A label's name in the whole raster; label 0 is one and the same everywhere."""
    return F.when(F.col(a) == 0, F.lit("0")).otherwise(F.concat_ws(".", tx, ty, a))


def _levels(passes: DataFrame) -> DataFrame:
    """label, level: the height at which each label reaches label 0, by the lowest way."""
    spark = passes.sparkSession
    passes = cut(passes)
    if passes.count() <= MAX_PASSES:
        near = defaultdict(list)
        for a, b, v in passes.toPandas().itertuples(index=False):
            near[a].append((b, v))
            near[b].append((a, v))
        level: dict[str, float] = {}
        heap = [(-np.inf, "0")]
        while heap:
            v, a = heapq.heappop(heap)
            if a in level:
                continue
            level[a] = v
            for b, height in near[a]:
                if b not in level:
                    heapq.heappush(heap, (max(v, height), b))
        found = [(k, float(v)) for k, v in level.items() if k != "0"]
        return spark.createDataFrame(found, "label string, level double")
    both = cut(passes.unionByName(passes.select(F.col("b").alias("a"), F.col("a").alias("b"), "v")))
    now = spark.createDataFrame([("0", float("-inf"))], "label string, level double")
    while True:  # each round lowers what it can; the levels are heights of passes, so it ends
        reach = both.join(now, both["a"] == now["label"]).select(F.col("b").alias("label"), F.greatest("level", "v").alias("level"))
        new = cut(now.unionByName(reach).groupBy("label").agg(F.min("level").alias("level")))
        if new.exceptAll(now).isEmpty():
            return new.where("label <> '0'")
        now = new


def fill(dem: Raster, neighbours: int = 8, tile: int = TILE) -> Raster:
    """The lowest surface above the DEM from which every cell drains to the grid's edge or to NoData."""
    first = cut(_round_one(dem, neighbours, tile))
    cells = first.where("x IS NOT NULL")
    inner = first.where("x IS NULL").select(_name("a").alias("a"), _name("b").alias("b"), F.col("z").alias("v"))
    one_tile = dem.meta.width <= tile and dem.meta.height <= tile
    if one_tile:
        between = None
    else:
        border = cells.where(f"z IS NOT NULL AND (x % {tile} IN (0, {tile - 1}) OR y % {tile} IN (0, {tile - 1}))").select("x", "y", "z", "tx", "ty", _name("a").alias("name"))
        step = F.explode(F.array(*[F.struct((F.col("x") + DX[n]).cast("int").alias("x"), (F.col("y") + DY[n]).cast("int").alias("y")) for n in codes(neighbours)])).alias("q")
        reach = border.select("z", "tx", "ty", "name", step).select(F.col("z").alias("z1"), F.col("tx").alias("tx1"), F.col("ty").alias("ty1"), F.col("name").alias("a"), "q.x", "q.y")
        met = reach.join(border, ["x", "y"]).where("(tx <> tx1 OR ty <> ty1) AND a < name")
        between = met.groupBy("a", F.col("name").alias("b")).agg(F.min(F.greatest("z", "z1")).alias("v"))
    levels = _levels(inner if between is None else inner.unionByName(between))
    # what drains in its own tile is done; joined, it would all be one key
    done = cells.where("a = 0").select("x", "y", "z")
    rest = cells.where("a <> 0").withColumn("label", _name("a"))
    out = done.unionByName(rest.join(levels, "label", "left").select("x", "y", F.when(F.col("z").isNotNull(), F.greatest("z", "level")).alias("z")))
    return dem.with_cells(out, "fill depressions")


def pit_mask(dem: Raster, neighbours: int = 8, tile: int = TILE) -> Raster:
    """1 in a depression, 0 outside, NoData kept (3 in files)."""
    full = fill(dem, neighbours, tile).cells.withColumnRenamed("z", "w")
    cells = dem.cells.join(full, ["x", "y"]).select("x", "y", F.when(F.col("z").isNotNull(), (F.col("w") > F.col("z")).cast("double")).alias("z"))
    return dem.with_cells(cells, "pit mask", no_data=3)


def has_depressions(dem: Raster, neighbours: int = 8, tile: int = TILE) -> bool:
    return not pit_mask(dem, neighbours, tile).cells.where("z = 1").isEmpty()


def fill_epsilon(dem: Raster, neighbours: int = 8, single: bool = False) -> Raster:
    """Filled with the least gradient that floating point has (single: of 32 bits)."""
    kind = np.float32 if single else np.float64
    return alone(dem, lambda z: kernels.epsilon_filled(z, neighbours, kind)[0], "fill depressions with a gradient")


def fill_up_to(dem: Raster, most: int, neighbours: int = 8) -> Raster:
    return alone(dem, lambda z: kernels.filled_up_to(z, most, neighbours), f"fill depressions of up to {most} cells")


def flood_directions(dem: Raster) -> Raster:
    return alone(dem, kernels.directions, "flood directions", no_data=0)


def watersheds(dem: Raster, neighbours: int = 8) -> Raster:
    """Labels: the flat id of the cell where each watershed's flood began."""
    return alone(dem, lambda z: kernels.watersheds(z, neighbours)[0], "watersheds", no_data=-1)


def watersheds_and_fill(dem: Raster, neighbours: int = 8) -> Raster:
    return alone(dem, lambda z: kernels.watersheds(z, neighbours)[1], "watersheds, filled")


def breach(dem: Raster, mode: str = "complete", neighbours: int = 8, epsilon: bool = False, fill: bool = False, max_length: int = 1 << 31, max_depth: float = float("inf")) -> Raster:
    return alone(dem, lambda z: kernels.breached(z, mode, neighbours, epsilon, fill, max_length, max_depth), f"{mode} breaching")
