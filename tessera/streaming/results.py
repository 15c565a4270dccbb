"""Results that arrive while a run goes on: a summary of all so far, and exact duplicates dropped as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: A measured result as it is appended, one CSV file for each image or more.
RESULT = "path string, category string, pixels long, a_bytes long, b_bytes long, c_bytes long, a_us long, b_us long, c_us long, difference int, at timestamp"


def read(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(RESULT).option("header", True).option("maxFilesPerTrigger", per_trigger).csv(folder)


def once(results: DataFrame, late: str = "1 day") -> DataFrame:
    """Each path's result once; state is kept for as long as a repeated one may come late."""
    return results.withWatermark("at", late).dropDuplicatesWithinWatermark(["path"])


def summary(results: DataFrame) -> DataFrame:
    """Totals and wins by category of what has come so far. Sums only, so state is a row for each category."""
    return results.groupBy(F.lower("category").alias("category")).agg(
        F.count("*").alias("images"), F.sum("pixels").alias("pixels"), F.sum("a_bytes").alias("a_bytes"), F.sum("b_bytes").alias("b_bytes"), F.sum("c_bytes").alias("c_bytes"),
        F.count_if(F.col("a_bytes") < F.col("b_bytes")).alias("wins_b"), F.count_if(F.col("difference") == 0).alias("exact"),
    )


def start(table: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Runs over what is there and keeps the result in a table in memory; a stopped run goes on from its checkpoint."""
    return table.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
