"""A Spark-first engine for raster data and the corpora that hold it."""
