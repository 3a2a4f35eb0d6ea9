"""talus: terrain, raster and text analytics on Spark."""
