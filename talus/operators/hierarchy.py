"""Depression hierarchy, and water filling, spilling and merging in it.

Basins are grown in one task (elevation order is global; at most `MAX_ALONE`
cells). Their outlets are a stencil over tiles and one aggregate over pairs of
labels, so the driver sees one row for each pair of neighbouring basins, from
which it builds the forest. Volumes are an aggregate over cells; a water level
comes from running sums over the cells of a depression.

Ocean is NoData and the cells that the caller marks. Water that reaches it is gone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions import hierarchy as kernels
from talus.functions.hierarchy import OCEAN, Forest
from talus.functions.topology import DX, DY, codes
from talus.operators.flood import MAX_ALONE
from talus.plans.checkpoints import cut
from talus.plans.halo import over_tiles, rows, shifted
from talus.raster import Raster

STEPS = {n: (int(DX[n]), int(DY[n])) for n in range(1, 9)}


def _whole(dem: Raster, cells: DataFrame, schema: str, work) -> DataFrame:
    """work(z, ocean, columns of the table as arrays) gives the columns of the cells' rows, as arrays over the grid or None to leave out."""
    w, h = dem.meta.width, dem.meta.height
    if w * h > MAX_ALONE:
        raise ValueError(f"basins are grown in one task, for up to {MAX_ALONE} cells")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
        grids = {}
        for name in table.column_names:
            if name not in ("x", "y", "g"):
                grids[name] = np.full((h, w), np.nan)
                grids[name][y, x] = table.column(name).to_numpy(zero_copy_only=False).astype(float)
        made = work(grids)
        return pa.table({"x": pa.array(x, pa.int32()), "y": pa.array(y, pa.int32())} | {n: made[n][y, x] for n in names[2:]})

    return cells.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(run, schema)


def seeds(dem: Raster, ocean: Column | None = None, neighbours: int = 8) -> DataFrame:
    """x, y, kind: 1 for ocean cells beside land, 2 for land without a lower neighbour."""
    sea = F.coalesce(ocean, F.lit(False)) if ocean is not None else F.lit(False)
    cells = dem.cells.select("x", "y", F.when(~sea, F.col("z")).cast("double").alias("z"))

    def kernel(box, present, z):
        own, off = shifted(z, 0, 0), box.off_grid()
        land = ~np.isnan(own)
        lowest, coast = np.full(own.shape, np.inf), np.zeros(own.shape, dtype=bool)
        for n in codes(neighbours):
            near, beyond = shifted(z, DX[n], DY[n]), shifted(off, DX[n], DY[n])
            lowest = np.minimum(lowest, np.where(beyond, np.inf, np.where(np.isnan(near), -np.inf, near)))
            coast |= ~np.isnan(near)
        kind = np.where(~land & coast, 1, np.where(land & (lowest >= own), 2, 0))
        return rows(box, present & (kind > 0), kind=kind)

    return over_tiles(Raster(cells, dem.meta), kernel, "x int, y int, kind int")


def basins(dem: Raster, ocean: Column | None = None, neighbours: int = 8) -> DataFrame:
    """x, y, z, label (0 drains to the ocean), direction, rank."""
    sea = F.coalesce(ocean, F.lit(False)) if ocean is not None else F.lit(False)
    cells = dem.cells.select("x", "y", F.col("z").cast("double").alias("z"), sea.cast("int").alias("sea"))

    def work(grids: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        label, direction, rank = kernels.basins(grids["z"], grids["sea"] == 1, neighbours)
        return {"z": grids["z"], "label": label, "direction": direction, "rank": rank}

    grown = _whole(dem, cells, "x int, y int, z double, label long, direction long, rank long", work)
    # ocean cells take no part in what follows
    return grown.withColumn("z", F.when((F.col("label") == OCEAN) & (F.col("direction") == 0), F.lit(float("-inf"))).otherwise(F.col("z")))


def outlets(dem: Raster, grown: DataFrame, neighbours: int = 8) -> DataFrame:
    """a, b, elevation, x, y: the lowest pass between each two neighbouring basins, the higher of its two cells' elevation."""

    def kernel(box, present, z, label):
        height, own = shifted(z, 0, 0), shifted(label, 0, 0)
        parts = []
        for n in codes(neighbours):
            other = shifted(label, DX[n], DY[n])
            with np.errstate(invalid="ignore"):
                meet = present & (own < other)
            inside = rows(box, meet, a=own, b=other, elevation=np.maximum(height, shifted(z, DX[n], DY[n])))
            parts.append(pd.DataFrame(inside))
        found = pd.concat(parts).sort_values(["a", "b", "elevation", "y", "x"]).drop_duplicates(["a", "b"])
        return {c: found[c].to_numpy() for c in ("x", "y", "a", "b", "elevation")}

    bands = Raster(grown.select("x", "y", "z", F.col("label").cast("double").alias("label")), dem.meta)
    found = over_tiles(bands, kernel, "x int, y int, a double, b double, elevation double", bands=("z", "label"))
    lowest = found.groupBy("a", "b").agg(F.min(F.struct("elevation", "y", "x")).alias("p"))
    return lowest.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "p.elevation", "p.x", "p.y")


def hierarchy(dem: Raster, ocean: Column | None = None, neighbours: int = 8) -> tuple[DataFrame, Forest]:
    """The cells (as from `basins`, checkpointed) and the forest of their depressions, with volumes."""
    grown = cut(basins(dem, ocean, neighbours))
    found = [(r.elevation, r.a, r.b, r.x, r.y) for r in outlets(dem, grown, neighbours).collect()]
    forest = Forest.merged(grown.agg(F.max("label")).first()[0] or 0, found)

    def at_home(label: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([forest.home(k, e) for k, e in zip(label, z)])

    home = F.pandas_udf(at_home, "long")
    own = grown.where(F.col("label") > OCEAN).select(home("label", "z").alias("home"), "z").groupBy("home").agg(F.count("*").alias("n"), F.sum("z").alias("total"))
    forest.measure({r.home: (r.n, r.total) for r in own.collect()})
    return grown, forest


def table(spark, forest: Forest) -> DataFrame:
    """One row for each depression but the ocean."""
    made = [(d.label, d.parent, *(d.parts or (-1, -1)), float(d.out_elevation), d.out_x, d.out_y, d.neighbour, d.lands_in, d.to_ocean, d.cells, float(d.volume), float(d.water)) for d in forest.depressions[1:]]
    return spark.createDataFrame(made, "label long, parent long, left long, right long, out_elevation double, out_x int, out_y int, neighbour long, lands_in long, to_ocean boolean, cells long, volume double, water double")


def fill_spill_merge(dem: Raster, water: Raster, ocean: Column | None = None, neighbours: int = 8) -> tuple[Raster, Forest]:
    """Water that stands on each cell in the end (negative: room left in the ground), and the forest with its water."""
    grown, forest = hierarchy(dem, ocean, neighbours)
    spark = dem.cells.sparkSession
    put = grown.select("x", "y", "z", "label", "direction", "rank").join(water.cells.select("x", "y", F.coalesce("z", F.lit(0.0)).cast("double").alias("water")), ["x", "y"], "left").fillna(0.0, ["water"])

    def work(grids: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        label, direction, rank = (np.nan_to_num(grids[c], nan=-1).astype(np.int64) for c in ("label", "direction", "rank"))
        direction = np.maximum(direction, 0)
        held, arrived = kernels.into_pits(grids["z"], label, direction, rank, np.nan_to_num(grids["water"]), STEPS)
        pit = (label > OCEAN) & (direction == 0)
        came = np.where(pit, arrived[np.maximum(label, 0)], 0.0)
        # of the pit cells of a flat bottom, the first one reports
        first = np.zeros(label.shape, dtype=bool)
        _, at = np.unique(np.where(pit, label, 0).ravel(), return_index=True)
        first.ravel()[at] = True
        return {"z": grids["z"], "label": label, "held": held, "came": np.where(first, came, 0.0)}

    moved = cut(_whole(dem, put, "x int, y int, z double, label long, held double, came double", work))
    for r in moved.where("came > 0").select("label", "came").orderBy("label").collect():
        forest.pour(r.label, r.came)
    levels = spark.createDataFrame([(k, top, float(v)) for k, top, v in forest.surfaces() if v > 0], "label long, top long, volume double")
    wet = moved.join(levels, "label")
    order = Window.partitionBy("top").orderBy("z", "y", "x")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    n, total = F.row_number().over(order), F.sum("z").over(upto)
    lack = F.sum(F.greatest(-F.col("held"), F.lit(0.0))).over(upto)
    # with the first n cells under water the level is this; it is right if the next cell stays dry
    tried = wet.select("top", "z", ((F.col("volume") - lack + total) / n).alias("level"), F.lead("z").over(order).alias("following"))
    level = tried.where("following IS NULL OR level <= following").groupBy("top").agg(F.min("level").alias("level"))
    done = moved.join(levels.join(level, "top").select("label", "level"), "label", "left")
    stands = F.when(F.col("level") > F.col("z"), F.col("level") - F.col("z")).otherwise(F.col("held"))
    return dem.with_cells(done.select("x", "y", stands.alias("z")), "fill, spill, merge"), forest
