"""Layouts of tiles: a grid of file names in CSV, where a blank is a missing tile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.raster import Raster, RasterMeta


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """tx, ty, path of each tile; path is null for a missing one."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n+$", ""), "\n")).alias("ty", "line"))
    named = lines.select("ty", F.posexplode(F.split("line", ",")).alias("tx", "name"))
    return named.select("tx", "ty", F.nullif(F.trim("name"), F.lit("")).alias("path"))


def write_layout(tiles: DataFrame, path: str) -> None:
    """The CSV of tx, ty, path: a line for each row of tiles."""
    across = tiles.agg(F.max("tx").alias("w")).first()["w"] + 1
    cells = F.map_from_entries(F.collect_list(F.struct("tx", F.coalesce("path", F.lit("")).alias("p"))))
    line = F.concat_ws(",", F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(""))))
    tiles.groupBy("ty").agg(cells.alias("m")).select("ty", line.alias("value")).orderBy("ty").select("value").coalesce(1).write.mode("overwrite").text(path)


def mosaic(tiles: dict[tuple[int, int], Raster], tile_width: int, tile_height: int, across: int, down: int) -> Raster:
    """One raster of tiles at their places; where a tile is missing there is NoData."""
    moved = [r.cells.select((F.col("x") + tx * tile_width).cast("int").alias("x"), (F.col("y") + ty * tile_height).cast("int").alias("y"), "z") for (tx, ty), r in sorted(tiles.items())]
    first = next(iter(tiles.values())).meta
    meta = RasterMeta(tile_width * across, tile_height * down, first.no_data, first.geotransform, first.projection)
    return Raster(reduce(DataFrame.unionByName, moved), meta.stamped("mosaic"))


def largest_square(present: list[list[bool]]) -> tuple[int, int, int]:
    """(size, tx, ty) of the largest full square of tiles, by its lower right corner."""
    best, above = (0, 0, 0), [0] * (len(present[0]) if present else 0)
    for y, line in enumerate(present):
        now = []
        for x, here in enumerate(line):
            now.append((1 + min(above[x], above[x - 1], now[x - 1]) if x and y else 1) if here else 0)
            best = max(best, (now[x], x, y), key=lambda b: b[0])
        above = now
    return best


def suggest_tile_size(length: int, wanted: int, least: int) -> int:
    """The size nearest to the wanted one whose last tile is larger than the least, or fills up."""
    sizes = sorted(range(1, length + 1), key=lambda s: (abs(s - wanted), s))
    return next((s for s in sizes if length % s == 0 or length % s > least), length)
