"""Rasters as DataFrames of cells.

A raster is a DataFrame with x, y (int) and z, and a small description. A null
z, or no row, is NoData. Every operator is lazy unless it says so and returns a
new raster; the description keeps the history of operators.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RasterMeta:
    width: int
    height: int
    no_data: float = -9999.0
    geotransform: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    projection: str = ""
    history: tuple[str, ...] = ()
    metadata: dict[str, str] = field(default_factory=dict)

    @property
    def cell_length_x(self) -> float:
        return abs(self.geotransform[1])

    @property
    def cell_length_y(self) -> float:
        return abs(self.geotransform[5])

    @property
    def cell_area(self) -> float:
        return abs(self.geotransform[1] * self.geotransform[5])

    def stamped(self, what: str) -> RasterMeta:
        return replace(self, history=(*self.history, what))

    def to_geo(self, x: Column, y: Column) -> tuple[Column, Column]:
        g = self.geotransform
        return g[0] + x * g[1] + y * g[2], g[3] + x * g[4] + y * g[5]


class Raster:
    def __init__(self, cells: DataFrame, meta: RasterMeta):
        self.cells, self.meta = cells, meta

    # --- making ---------------------------------------------------------

    @staticmethod
    def filled(spark: SparkSession, width: int, height: int, value: float, **meta) -> Raster:
        i = F.col("id")
        cells = spark.range(width * height).select((i % width).cast("int").alias("x"), F.floor(i / width).cast("int").alias("y"), F.lit(float(value)).alias("z"))
        return Raster(cells, RasterMeta(width, height, **meta))

    @staticmethod
    def from_numpy(spark: SparkSession, array, no_data: float, **meta) -> Raster:
        import numpy as np
        import pyarrow as pa

        h, w = array.shape
        z = array.astype(float).ravel()
        i = np.arange(w * h, dtype=np.int32)
        table = pa.table({"x": i % w, "y": i // w, "z": pa.array(z, mask=(z == no_data) | np.isnan(z))})
        return Raster(spark.createDataFrame(table, "x int, y int, z double"), RasterMeta(w, h, no_data, **meta))

    def to_numpy(self):
        """A small raster as an array; for windows and tests."""
        import numpy as np

        out = np.full((self.meta.height, self.meta.width), float(self.meta.no_data))
        for x, y, z in self.cells.select("x", "y", "z").where("z IS NOT NULL").toPandas().itertuples(index=False):
            out[y, x] = z
        return out

    def like(self, value: float) -> Raster:
        return Raster.filled(self.cells.sparkSession, self.meta.width, self.meta.height, value)._meta(replace(self.meta, history=()))

    def _meta(self, meta: RasterMeta) -> Raster:
        return Raster(self.cells, meta)

    def with_z(self, z: Column, what: str) -> Raster:
        return Raster(self.cells.withColumn("z", z), self.meta.stamped(what))

    def with_cells(self, cells: DataFrame, what: str, **changes) -> Raster:
        return Raster(cells, replace(self.meta, **changes).stamped(what))

    # --- positions ------------------------------------------------------

    @property
    def flat_id(self) -> Column:
        return F.col("y").cast("long") * self.meta.width + F.col("x")

    @property
    def is_edge(self) -> Column:
        return (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == self.meta.width - 1) | (F.col("y") == self.meta.height - 1)

    @property
    def is_corner(self) -> Column:
        return F.col("x").isin(0, self.meta.width - 1) & F.col("y").isin(0, self.meta.height - 1)

    def in_grid(self, x: Column, y: Column) -> Column:
        return x.between(0, self.meta.width - 1) & y.between(0, self.meta.height - 1)

    # --- local operators ------------------------------------------------

    def stats(self) -> DataFrame:
        """min_z, max_z, n_data: one row; NoData is skipped."""
        return self.cells.agg(F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.count("z").alias("n_data"))

    def count_value(self, v: float | None) -> DataFrame:
        return self.cells.agg(F.count_if(F.col("z").eqNullSafe(F.lit(v))).alias("n"))

    def histogram(self) -> DataFrame:
        return self.cells.where("z IS NOT NULL").groupBy("z").agg(F.count("*").alias("n"))

    def replace(self, old: float | None, new: float | None) -> Raster:
        return self.with_z(F.when(F.col("z").eqNullSafe(F.lit(old)), F.lit(new)).otherwise(F.col("z")), f"replace {old} by {new}")

    def scale(self, k: float) -> Raster:
        return self.with_z(F.col("z") * k, f"scale {k}")

    def set_all(self, v: float | None) -> Raster:
        return self.with_z(F.lit(v).cast("double"), f"set all {v}")

    def set_no_data(self, v: float) -> Raster:
        """Declares another sentinel: cells of the old one become data, cells of the new one NoData."""
        old = F.coalesce("z", F.lit(self.meta.no_data))
        return Raster(self.cells.withColumn("z", F.when(old != v, old)), replace(self.meta, no_data=v).stamped(f"no data {v}"))

    def map(self, f: Callable[[Column], Column], what: str = "map") -> Raster:
        return self.with_z(f(F.col("z")), what)

    def set_edges(self, v: float) -> Raster:
        return self.with_z(F.when(self.is_edge, F.lit(float(v))).otherwise(F.col("z")), f"edges {v}")

    def set_row(self, y: int, v: float) -> Raster:
        return self.with_z(F.when(F.col("y") == y, F.lit(float(v))).otherwise(F.col("z")), f"row {y}")

    def set_col(self, x: int, v: float) -> Raster:
        return self.with_z(F.when(F.col("x") == x, F.lit(float(v))).otherwise(F.col("z")), f"column {x}")

    # --- reshaping ------------------------------------------------------

    def flip_vert(self) -> Raster:
        return self.with_cells(self.cells.withColumn("y", (self.meta.height - 1 - F.col("y")).cast("int")), "flip rows")

    def flip_horz(self) -> Raster:
        return self.with_cells(self.cells.withColumn("x", (self.meta.width - 1 - F.col("x")).cast("int")), "flip columns")

    def transpose(self) -> Raster:
        return self.with_cells(self.cells.select(F.col("y").alias("x"), F.col("x").alias("y"), "z"), "transpose", width=self.meta.height, height=self.meta.width)

    def crop(self, x0: int, y0: int, width: int, height: int) -> Raster:
        inside = self.cells.where(F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1))
        g = self.meta.geotransform
        moved = (g[0] + x0 * g[1] + y0 * g[2], g[1], g[2], g[3] + x0 * g[4] + y0 * g[5], g[4], g[5])
        return self.with_cells(inside.withColumn("x", (F.col("x") - x0).cast("int")).withColumn("y", (F.col("y") - y0).cast("int")), "crop", width=width, height=height, geotransform=moved)

    def expand(self, width: int, height: int, value: float | None) -> Raster:
        """Larger or smaller; the old cells stay at the upper left, new ones get the value."""
        old = self.cells.where((F.col("x") < width) & (F.col("y") < height)).withColumn("old", F.lit(True))
        grid = Raster.filled(self.cells.sparkSession, width, height, 0.0).cells.select("x", "y")
        cells = grid.join(old, ["x", "y"], "left").withColumn("z", F.when(F.col("old"), F.col("z")).otherwise(F.lit(value).cast("double"))).drop("old")
        return self.with_cells(cells, "expand", width=width, height=height)

    def pad(self, by: int, value: float | None = None) -> Raster:
        """A border around the raster: what a padded load gives."""
        wide = self.with_cells(self.cells.withColumn("x", (F.col("x") + by).cast("int")).withColumn("y", (F.col("y") + by).cast("int")), "pad")
        return wide.expand(self.meta.width + 2 * by, self.meta.height + 2 * by, value)

    def row(self, y: int) -> DataFrame:
        """The values of a row in order, as one array."""
        return _vector(self.cells.where(F.col("y") == y), "x")

    def col(self, x: int) -> DataFrame:
        return _vector(self.cells.where(F.col("x") == x), "y")

    # --- comparing ------------------------------------------------------

    def differing(self, other: Raster) -> DataFrame:
        """x, y, left, right of cells that differ, null against null being equal."""
        a, b = self.cells.select("x", "y", F.col("z").alias("left")), other.cells.select("x", "y", F.col("z").alias("right"))
        return a.join(b, ["x", "y"], "full").where(~F.col("left").eqNullSafe(F.col("right")))

    def equals(self, other: Raster) -> bool:
        same = (self.meta.width, self.meta.height, self.meta.no_data) == (other.meta.width, other.meta.height, other.meta.no_data)
        return same and self.differing(other).isEmpty()

    def diff_stats(self, other: Raster) -> DataFrame:
        """n, min_diff, max_diff, mean_diff, rms_diff over cells with data in both."""
        self._same_size(other)
        d = self.cells.select("x", "y", "z").join(other.cells.select("x", "y", F.col("z").alias("o")), ["x", "y"]).select((F.col("z") - F.col("o")).alias("d")).where("d IS NOT NULL")
        return d.agg(F.count("d").alias("n"), F.min("d").alias("min_diff"), F.max("d").alias("max_diff"), F.avg("d").alias("mean_diff"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms_diff"))

    def _same_size(self, other: Raster) -> None:
        if (self.meta.width, self.meta.height) != (other.meta.width, other.meta.height):
            raise ValueError("the rasters differ in size")

    def show(self, x: int = 0, y: int = 0, width: int = 20, height: int = 20) -> str:
        """A window as text."""
        part = self.crop(x, y, min(width, self.meta.width - x), min(height, self.meta.height - y)).to_numpy()
        return "\n".join(" ".join(f"{v:g}".rjust(6) for v in line) for line in part)


def _vector(cells: DataFrame, by: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), F.col("z").alias("z"))))
    return cells.agg(F.transform(ordered, lambda e: e["z"]).alias("values"))
