"""Rasters as DataFrames.

The row relation has a row for each raster line: img, y, line (array of samples) — for colour images a line of each of r, g, b and
a. It is what operators exchange: 64 samples in one record instead of 64 records. Samples are whole numbers from 0 up.

The views over `embeddings` make every operator testable on any size of that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = "(CAST(floor((CAST(e AS DOUBLE) + 1.0D) * 127.5D) AS INT) & 255)"


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y and line: one line of samples from 0 to 255 for each vector."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.select(F.col("vec_id").alias("y"), F.expr(f"transform(embedding, e -> {SAMPLE})").alias("line"))


def gray(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """One gray image: img, y, line; samples without their low `shift` bits."""
    return embeddings(spark, sf_dir).select(F.lit(0).alias("img"), "y", F.expr(f"transform(line, v -> v >> {shift})").alias("line"))


def rgba(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """One colour image, 16 wide: img, y, r, g, b, a (a line of each)."""
    every = lambda c: F.expr(f"transform(filter(line, (v, i) -> i % 4 = {c}), v -> v >> {shift})")
    return embeddings(spark, sf_dir).select(F.lit(0).alias("img"), "y", *(every(i).alias(n) for i, n in enumerate("rgba")))


def frames(spark: SparkSession, sf_dir: str, height: int = 50, shift: int = 0) -> DataFrame:
    """A sequence of gray frames: anim, frame, y, line."""
    rows = gray(spark, sf_dir, shift)
    return rows.select(F.lit(0).alias("anim"), F.expr(f"y div {height}").alias("frame"), F.expr(f"y % {height}").alias("y"), "line")


def pixels(rows: DataFrame, *keys: str) -> DataFrame:
    """A row for each sample of a row relation: keys, x and v."""
    return rows.select(*keys, F.posexplode("line").alias("x", "v"))


def colours(rows: DataFrame, *keys: str) -> DataFrame:
    """A row for each pixel of a colour row relation: keys, x, r, g, b, a."""
    return rows.select(*keys, F.posexplode(F.arrays_zip("r", "g", "b", "a")).alias("x", "p")).select(*keys, "x", "p.*")


def unexploded(samples: DataFrame, *keys: str) -> DataFrame:
    """Back to a row relation: lines in the order of x."""
    cells = F.array_sort(F.collect_list(F.struct("x", "v")))
    return samples.groupBy(*keys).agg(F.transform(cells, lambda c: c["v"]).alias("line"))


# ---------------------------------------------------------------- the same views as SQL common table expressions

PX = """px AS (SELECT y, CAST(x AS BIGINT) AS x, CAST(floor((CAST(e AS DOUBLE) + 1.0) * 127.5) AS INT) & 255 AS v0
    FROM (SELECT vec_id AS y, unnest(range(len(embedding))) AS x, unnest(embedding) AS e FROM embeddings))"""
GRAY = PX + ",\ngray AS (SELECT 0 AS img, y, x, v0 >> {shift} AS v FROM px)"
RGBA = (
    PX
    + ",\nrgba AS (SELECT 0 AS img, y, x // 4 AS x, max(CASE WHEN x % 4 = 0 THEN v0 >> {shift} END) AS r, max(CASE WHEN x % 4 = 1 THEN v0 >> {shift} END) AS g,"
    " max(CASE WHEN x % 4 = 2 THEN v0 >> {shift} END) AS b, max(CASE WHEN x % 4 = 3 THEN v0 >> {shift} END) AS a FROM px GROUP BY y, x // 4)"
)
STENCIL = """lags AS (SELECT *, lag(v) OVER r AS lw, lag(v, 2) OVER r AS lww, lag(v) OVER c AS ln, lag(v, 2) OVER c AS lnn FROM gray
    WINDOW r AS (PARTITION BY img, y ORDER BY x), c AS (PARTITION BY img, x ORDER BY y)),
more AS (SELECT *, lag(ln) OVER r AS lnw, lead(ln) OVER r AS lne FROM lags WINDOW r AS (PARTITION BY img, y ORDER BY x)),
st AS (SELECT img, y, x, v, coalesce(lw, ln, {half}) AS W, coalesce(ln, lw, {half}) AS N, coalesce(lnw, ln, lw, {half}) AS NW, coalesce(lne, ln, lw, {half}) AS NE,
    coalesce(lww, lw, ln, {half}) AS WW, coalesce(lnn, ln, lw, {half}) AS NN, lw, ln, lnw FROM more)"""


def gray_sql(shift: int = 0) -> str:
    return "WITH " + GRAY.format(shift=shift)


def rgba_sql(shift: int = 0) -> str:
    return "WITH " + RGBA.format(shift=shift)


def stencil_sql(shift: int = 0, half: int = 128) -> str:
    return gray_sql(shift) + ",\n" + STENCIL.format(half=half)
