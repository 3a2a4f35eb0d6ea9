"""Sources and sinks: ESRI ASCII grids, Parquet tiles, and generated terrain."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.raster import Raster, RasterMeta

HEADER = ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their numbers, from where each partition starts; only a count per partition is gathered."""
    lines = spark.read.text(path).withColumn("id", F.monotonically_increasing_id())
    part, within = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["p"], r["count"]) for r in lines.groupBy(part.alias("p")).count().collect())
    starts, total = {}, 0
    for p, n in counts:
        starts[p], total = total, total + n
    offsets = F.create_map(*[F.lit(v).cast("long") for kv in starts.items() for v in kv]) if starts else F.create_map()
    return lines.select("value", (F.element_at(offsets, part.cast("long")) + within).alias("line")) if starts else lines.select("value", F.lit(0).cast("long").alias("line"))


def header(spark: SparkSession, path: str) -> RasterMeta:
    """Size, corner and NoData of an ASCII grid, from its first six lines."""
    words = [r["value"].split() for r in spark.read.text(path).limit(6).collect()]
    h = {w[0].lower(): float(w[1]) for w in words if len(w) == 2}
    missing = set(HEADER[:2]) - set(h)
    if missing:
        raise ValueError(f"not an ASCII grid: {sorted(missing)} missing")
    size = h.get("cellsize", 1.0)
    rows = int(h["nrows"])
    corner = (h.get("xllcorner", 0.0), size, 0.0, h.get("yllcorner", 0.0) + rows * size, 0.0, -size)
    return RasterMeta(int(h["ncols"]), rows, h.get("nodata_value", -9999.0), corner, history=(f"read {path}",))


def read_ascii(spark: SparkSession, path: str) -> Raster:
    """A grid of text: six header lines, then a line for each row from the north."""
    meta = header(spark, path)
    body = _numbered(spark, path).where("line >= 6").select((F.col("line") - 6).cast("int").alias("y"), F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("v")).where(F.col("y") < meta.height)
    cells = body.select("y", F.posexplode("v").alias("x", "t")).where(F.col("t") != "").select("x", "y", F.nullif(F.col("t").cast("double"), F.lit(meta.no_data)).alias("z"))
    return Raster(cells, meta)


def write_ascii(raster: Raster, path: str) -> None:
    """A folder with one text file; each line is one row, so no task holds more than a row of cells at a time."""
    m, spark = raster.meta, raster.cells.sparkSession
    g = m.geotransform
    top = [f"ncols {m.width}", f"nrows {m.height}", f"xllcorner {g[0]:g}", f"yllcorner {g[3] + g[5] * m.height:g}", f"cellsize {m.cell_length_x:g}", f"NODATA_value {m.no_data:g}"]
    text = F.format_string("%s", F.coalesce("z", F.lit(float(m.no_data))).cast("string"))
    held = F.map_from_entries(F.collect_list(F.struct("x", text.alias("t"))))
    line = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(m.width - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(f"{m.no_data}"))))
    grid = spark.range(m.height).select(F.col("id").cast("int").alias("y")).join(raster.cells.groupBy("y").agg(held.alias("m")), "y", "left")
    rows = grid.select("y", F.when(F.col("m").isNull(), F.lit(" ".join([f"{m.no_data}"] * m.width))).otherwise(line).alias("value"))
    head = spark.createDataFrame([(k - 6, t) for k, t in enumerate(top)], "y int, value string")
    head.unionByName(rows).orderBy("y").coalesce(1).select("value").write.mode("overwrite").text(path)


def write_tiles(raster: Raster, path: str, tile: int = 256) -> None:
    """Parquet in folders by tile: what a reader needs of a window is found by folder and column statistics."""
    cells = raster.cells.withColumn("tx", F.floor(F.col("x") / tile).cast("int")).withColumn("ty", F.floor(F.col("y") / tile).cast("int"))
    cells.repartition("ty", "tx").sortWithinPartitions("ty", "tx", "y", "x").write.mode("overwrite").option("compression", "zstd").partitionBy("ty", "tx").parquet(path)


def read_tiles(spark: SparkSession, path: str, meta: RasterMeta, window: tuple[int, int, int, int] | None = None, tile: int = 256) -> Raster:
    """A raster, or a window (x0, y0, width, height) of one, of which only the tiles it touches are read."""
    cells = spark.read.parquet(path)
    if window is None:
        return Raster(cells.select("x", "y", "z"), meta)
    x0, y0, w, h = window
    near = cells.where(F.col("tx").between(x0 // tile, (x0 + w - 1) // tile) & F.col("ty").between(y0 // tile, (y0 + h - 1) // tile))
    return Raster(near.select("x", "y", "z"), meta).crop(x0, y0, w, h)


def perlin(spark: SparkSession, size: int, seed: int = 0) -> Raster:
    """Smooth random terrain: gradient noise at (10 x / size, 10 y / size, 0.8), the same for a seed everywhere."""
    order = np.random.default_rng(seed).permutation(256)
    table = np.concatenate((order, order))

    def noise(x: np.ndarray, y: np.ndarray, z: float) -> np.ndarray:
        xi, yi, zi = np.floor(x).astype(int) & 255, np.floor(y).astype(int) & 255, int(z) & 255
        x, y, z = x - np.floor(x), y - np.floor(y), z - int(z)
        ease = lambda t: t * t * t * (t * (t * 6 - 15) + 10)
        u, v, w = ease(x), ease(y), ease(z)

        def slope(corner: np.ndarray, dx, dy, dz) -> np.ndarray:
            h = corner & 15
            a = np.where(h < 8, dx, dy)
            b = np.where(h < 4, dy, np.where((h == 12) | (h == 14), dx, dz))
            return np.where(h & 1, -a, a) + np.where(h & 2, -b, b)

        def at(i: int, j: int, k: int) -> np.ndarray:
            return slope(table[table[table[xi + i] + yi + j] + zi + k], x - i, y - j, z - k)

        mix = lambda t, a, b: a + t * (b - a)
        plane = [mix(v, mix(u, at(0, 0, k), at(1, 0, k)), mix(u, at(0, 1, k), at(1, 1, k))) for k in (0, 1)]
        return mix(w, *plane)

    def run(batches):
        for b in batches:
            i = b.column(0).to_numpy()
            x, y = i % size, i // size
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(noise(10 * x / size, 10 * y / size, 0.8))], names=["x", "y", "z"])

    cells = spark.range(size * size).mapInArrow(run, "x int, y int, z double")
    return Raster(cells, RasterMeta(size, size, -1.0).stamped(f"perlin {seed}"))
