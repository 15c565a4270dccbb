"""Reports as files: results appended as CSV, summaries as JSON and Markdown, manifests read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "Path string, Category string, Width int, Height int, Pixels long, ColorModel string, NormalizedSHA256 string, Source string"


def append_csv(rows: DataFrame, folder: str) -> None:
    """Adds rows to a folder of CSV files, each with its header. A run that is stopped leaves what it had committed; a summary may read the
    folder at any time."""
    rows.write.mode("append").option("header", True).csv(folder)


def read_csv(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest; rows without a path or a size are errors of whoever wrote it and end the job."""
    rows = read_csv(spark, folder, MANIFEST)
    whole = F.col("Path").isNotNull() & (F.col("Width") > 0) & (F.col("Height") > 0)
    return rows.withColumn("Path", F.when(F.coalesce(whole, F.lit(False)), F.col("Path")).otherwise(F.raise_error(F.lit("a manifest row without a path or a size"))))


def write_json(summary: DataFrame, folder: str) -> None:
    """A line of JSON for each row; nulls are written, so every line has every name."""
    summary.write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def markdown(summary: DataFrame, *order: str) -> DataFrame:
    """line and text: a summary as a table in Markdown, its rows ordered by columns without regard to case. Bars and line ends in values
    are escaped. A summary is a report: its rows go through one task."""
    names = summary.columns
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")
    text = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(f"`{c}`") for c in names)), F.lit(" |"))
    keys = [F.lower(F.col(f"`{c}`").cast("string")) for c in order] + [F.col(f"`{c}`") for c in order]
    body = summary.select(text.alias("text"), F.struct(*keys).alias("_key")) if order else summary.select(text.alias("text"), F.struct(text.alias("t")).alias("_key"))
    lines = body.agg(F.array_sort(F.collect_list(F.struct("_key", "text"))).alias("rows")).select(F.transform("rows", lambda r: r["text"]).alias("rows"))
    numeric = {f.name for f in summary.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")}
    head = F.array(F.lit("| " + " | ".join(names) + " |"), F.lit("|" + "|".join("---:" if c in numeric else "---" for c in names) + "|"))
    return lines.select(F.posexplode(F.concat(head, "rows")).alias("line", "text"))


def write_text(lines: DataFrame, folder: str) -> None:
    """line and text as one text file."""
    lines.orderBy("line").select("text").coalesce(1).write.mode("overwrite").text(folder)
