"""A raster analytics engine on PySpark: rasters are DataFrames of cells."""
