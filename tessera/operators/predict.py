"""Prediction: residuals of all predictors, tile costs and choices, byte filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import formulas as f
from tessera.operators.neighbors import byte_stencil

#: Byte filters by number; L, U and UL are the bytes left, up and up-left.
_PAE = f.named(f.PAETH, W="L", N="U", NW="UL")
BYTE_FILTERS = ["0", "L", "U", "((L + U) >> 1)", _PAE, "greatest(0, least(255, L + U - UL))"]


def _e(text: str, m: int = 255) -> Column:
    return F.expr(f.spark(f.named(text, M=m)))


def residual(prediction: str, m: int = 255) -> Column:
    return _e(f.residual("v", prediction), m)


def total_errors(stencil: DataFrame, predictors: list[str], m: int = 255) -> DataFrame:
    """id and abs_sum: the sum of residual sizes of each predictor, in one pass without exploding."""
    sums = stencil.agg(F.array(*(F.sum(F.abs(residual(p, m))) for p in predictors)).alias("s"))
    return sums.select(F.posexplode("s").alias("id", "abs_sum"))


def tile_costs(stencil: DataFrame, predictors: list[str], log: int, m: int = 255) -> DataFrame:
    """img, ty, tx and costs (array, one for each predictor) of tiles of 2 ** log by 2 ** log."""
    costs = [F.sum(_e(f.cost(f"abs({f.residual('v', p)})"), m)) for p in predictors]
    return stencil.groupBy("img", F.expr(f"y >> {log}").alias("ty"), F.expr(f"x >> {log}").alias("tx")).agg(F.array(*costs).alias("costs"))


def coarser(costs: DataFrame, by: int) -> DataFrame:
    """Costs of tiles 2 ** by times as wide and high: exact sums of the finer ones."""
    one = costs.select("img", F.expr(f"ty >> {by}").alias("ty"), F.expr(f"tx >> {by}").alias("tx"), F.posexplode("costs").alias("id", "cost"))
    sums = one.groupBy("img", "ty", "tx", "id").agg(F.sum("cost").alias("cost"))
    return sums.groupBy("img", "ty", "tx").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "cost"))), lambda c: c["cost"]).alias("costs"))


def cheapest(costs: DataFrame) -> DataFrame:
    """The predictor of least cost of each tile; ties to the lowest number."""
    ranked = F.array_min(F.transform("costs", lambda c, i: F.struct(c.alias("cost"), i.alias("id"))))
    return costs.withColumn("m", ranked).select("img", "ty", "tx", F.col("m.id").alias("id"), F.col("m.cost").alias("cost"))


def line_filters(rows: DataFrame, choices: tuple[int, ...] = (1, 2, 5)) -> DataFrame:
    """img, y, filter and score: the byte filter of least sum of wrapped residual sizes on each line; ties to the first of `choices`."""
    score = lambda t: F.sum(F.expr(f"least((v - ({t})) & 255, 256 - ((v - ({t})) & 255))"))
    sums = byte_stencil(rows).groupBy("img", "y").agg(F.array(*(F.struct(score(BYTE_FILTERS[c]).alias("score"), F.lit(i).alias("place"), F.lit(c).alias("filter")) for i, c in enumerate(choices))).alias("s"))
    return sums.withColumn("m", F.array_min("s")).select("img", "y", F.col("m.filter").alias("filter"), F.col("m.score").alias("score"))


def noise(rows: DataFrame, limit: int = 78) -> DataFrame:
    """img, pixels, total, pairs and noisy: mean size of the difference of samples `step` apart in line order, step being pixels div 262144 + 1.

    A line takes the place of its first sample from the widths above it, so only widths go through the window over an image's lines."""
    width = rows.select("img", "y", F.size("line").cast("long").alias("w"))
    base = F.coalesce(F.sum("w").over(W.partitionBy("img").orderBy("y").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("w").over(W.partitionBy("img"))
    place = width.select("img", "y", base.alias("base"), whole.alias("pixels"))
    cells = rows.join(place, ["img", "y"]).select("img", "pixels", F.expr("pixels div 262144 + 1").alias("step"), "base", F.posexplode("line").alias("x", "v")).withColumn("i", F.col("base") + F.col("x"))
    cells = cells.filter(F.col("i") % F.col("step") == 0).withColumn("k", F.expr("i div step"))
    # neighbours k and k - 1 meet by key, not in an order over the whole image
    both = cells.select("img", "pixels", "k", F.col("v"), F.lit(0).alias("late")).unionByName(cells.select("img", "pixels", (F.col("k") + 1).alias("k"), "v", F.lit(1).alias("late")))
    pair = both.groupBy("img", "pixels", "k").agg(F.count("*").alias("n"), F.abs(F.sum(F.when(F.col("late") == 0, F.col("v")).otherwise(-F.col("v")))).alias("d")).filter("n = 2")
    sums = pair.groupBy("img", "pixels").agg(F.sum("d").alias("total"), F.count("*").alias("pairs"))
    return sums.withColumn("noisy", F.expr(f"pixels >= 4096 AND total div pairs > {limit}"))


def cheapest_in_context(costs: DataFrame, penalty: int) -> DataFrame:
    """img, ty, tx and id: as `cheapest`, where telling a predictor costs too. A tile that follows the one left of it is free, one that follows the
    one above where that differs from the left one costs `penalty`, any other five times that; in the first column only the tile above counts.

    A choice depends on the ones before it, so an image's tiles are one task: some numbers for each 64 samples or more."""

    def choose(tiles: pa.Table) -> pa.Table:
        y, x, cost = (tiles.column(c).combine_chunks() for c in ("ty", "tx", "costs"))
        order = np.lexsort((x.to_numpy(), y.to_numpy()))
        y, x, cost = y.to_numpy()[order], x.to_numpy()[order], cost.flatten().to_numpy().reshape(len(order), -1)[order]
        chosen: dict[tuple[int, int], int] = {}
        for ty, tx, each in zip(y.tolist(), x.tolist(), cost):
            left, up = chosen.get((ty, tx - 1)), chosen.get((ty - 1, tx))
            extra = np.zeros(len(each), np.int64)
            if left is not None or up is not None:
                extra += 5 * penalty
                if left is not None:
                    if up is not None and up != left:
                        extra[up] = penalty
                    extra[left] = 0
                else:
                    extra[up] = 0
            chosen[ty, tx] = int((each + extra).argmin())
        image = tiles.column("img").combine_chunks().take(pa.array(order))
        return pa.table({"img": image, "ty": pa.array(y), "tx": pa.array(x), "id": pa.array([chosen[k] for k in zip(y.tolist(), x.tolist())], pa.int32())})

    types = {f.name: f.dataType.simpleString() for f in costs.schema}
    return costs.select("img", "ty", "tx", "costs").groupBy("img").applyInArrow(choose, f"img {types['img']}, ty {types['ty']}, tx {types['tx']}, id int")
