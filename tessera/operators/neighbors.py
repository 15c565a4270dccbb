"""Neighbour stencils: every sample with those west, north, north-west, north-east, two west and two north of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BAND = 128


def with_lines_above(rows: DataFrame, *columns: str, image: tuple[str, ...] = ("img",), reach: int = 2) -> DataFrame:
    """rows with the same columns of the line above (`c_up`) and of the one above that (`c_up2`), null where there is none.

    Lines are dealt in bands, and a band gets the last lines of the band before it too, so one exchange of lines does for
    any stencil and an image of any height is many tasks."""
    band = F.expr(f"y div {BAND}")
    homes = F.when(F.expr(f"y % {BAND}") >= BAND - reach, F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band + 1).alias("band"), F.lit(False).alias("own"))))
    dealt = rows.withColumn("_h", F.explode(F.coalesce(homes, F.array(F.struct(band.alias("band"), F.lit(True).alias("own"))))))
    dealt = dealt.withColumns({"_band": F.col("_h.band"), "_own": F.col("_h.own")}).drop("_h")
    order = W.partitionBy(*image, "_band").orderBy("y")
    above = {}
    for n, name in ((1, "up"), (2, "up2")):
        for c in columns:
            above[f"{c}_{name}"] = F.when(F.lag("y", n).over(order) == F.col("y") - n, F.lag(c, n).over(order))
    return dealt.withColumns(above).filter("_own").drop("_band", "_own")


def stencil(rows: DataFrame, half: int = 128, *keys: str) -> DataFrame:
    """img, y, keys, x, v, W, N, NW, NE, WW, NN. Outside the image: W falls back to N and then `half`, N to W, NW and NE to N, WW to W, NN to N."""
    lines = with_lines_above(rows, "line")
    cells = lines.select("img", "y", *keys, "line", "line_up", "line_up2", F.posexplode("line").alias("x", "v"))
    w = f"coalesce(get(line, x - 1), get(line_up, x), {half})"
    n = f"coalesce(get(line_up, x), get(line, x - 1), {half})"
    return cells.select(
        "img", "y", *keys, "x", "v", F.expr(w).alias("W"), F.expr(n).alias("N"),
        F.expr(f"coalesce(get(line_up, x - 1), {n})").alias("NW"), F.expr(f"coalesce(get(line_up, x + 1), {n})").alias("NE"),
        F.expr(f"coalesce(get(line, x - 2), {w})").alias("WW"), F.expr(f"coalesce(get(line_up2, x), {n})").alias("NN"),
    )


def byte_stencil(rows: DataFrame) -> DataFrame:
    """y, x, v, L, U, UL for byte filters: outside the image everything is 0."""
    lines = with_lines_above(rows, "line", reach=1)
    cells = lines.select("img", "y", "line", "line_up", F.posexplode("line").alias("x", "v"))
    at = lambda line, i: F.expr(f"coalesce(get({line}, {i}), 0)")
    return cells.select("img", "y", "x", "v", at("line", "x - 1").alias("L"), at("line_up", "x").alias("U"), at("line_up", "x - 1").alias("UL"))
