"""Elevation rasters derived from the star-schema tables, by integer arithmetic that every engine does alike."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from talus.raster import Raster, RasterMeta


def dem(spark: SparkSession, sf_dir: str, width: int = 64, trend: int = 0) -> Raster:
    """Noise from line items; trend adds a slope so that flow paths are long."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    x, y = F.expr(f"CAST(l_orderkey % {width} AS INT)"), F.expr(f"CAST((l_orderkey div {width} + l_linenumber * 7) % {width} AS INT)")
    cells = items.groupBy(x.alias("x"), y.alias("y")).agg((F.sum(F.col("l_quantity").cast("long")) % 97).cast("double").alias("z"))
    if trend:
        cells = cells.withColumn("z", trend * (F.col("x") + F.col("y")) + F.col("z") % 7)
    return Raster(cells, RasterMeta(width, width))
