"""Sequences of frames: differences, kinds of frames, timelines and motion votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def deltas(frames: DataFrame) -> DataFrame:
    """anim, frame, x0, y0, w, h, changed: the rectangle of samples that differ from the frame before; nulls and 0 if none do.

    A line meets the same line of the frame before by key, so no frame is one task; the first frame has no row."""
    before = frames.select("anim", (F.col("frame") + 1).alias("frame"), "y", F.col("line").alias("old"))
    both = frames.join(before, ["anim", "frame", "y"])
    at = F.expr("filter(sequence(0, size(line) - 1), i -> line[i] <> old[i])")
    lines = both.select("anim", "frame", "y", at.alias("at")).withColumn("n", F.size("at"))
    y = F.when(F.col("n") > 0, F.col("y"))
    x0, x1 = F.min(F.array_min("at")), F.max(F.array_max("at"))
    return lines.groupBy("anim", "frame").agg(
        x0.alias("x0"), F.min(y).alias("y0"), (x1 - x0 + 1).alias("w"), (F.max(y) - F.min(y) + 1).alias("h"), F.sum("n").alias("changed")
    )


def kinds(frames: DataFrame) -> DataFrame:
    """anim, frame, kind: key, duplicate, or rectangle where the changed one is at most half the frame."""
    size = frames.groupBy("anim", "frame").agg(F.sum(F.size("line")).alias("pixels"))
    joined = size.join(deltas(frames), ["anim", "frame"], "left")
    kind = F.when(F.col("changed").isNull(), "key").when(F.col("changed") == 0, "duplicate").when(2 * F.col("w") * F.col("h") <= F.col("pixels"), "rectangle").otherwise("key")
    return joined.select("anim", "frame", kind.alias("kind"))


def timeline(delays: DataFrame) -> DataFrame:
    """anim, frame, delay, start: when a frame begins. A delay of 0 lasts 100."""
    delay = F.when(F.col("delay") == 0, 100).otherwise(F.col("delay"))
    table = delays.withColumn("delay", delay)
    earlier = W.partitionBy("anim").orderBy("frame").rowsBetween(W.unboundedPreceding, -1)
    return table.select("anim", "frame", "delay", F.coalesce(F.sum("delay").over(earlier), F.lit(0)).alias("start"))


def played(timeline: DataFrame, loops: int, until: int | None = None) -> DataFrame:
    """anim, loop, frame, start: when each frame begins while a sequence is played `loops` times over (0: until `until`, which then must be given).
    timeline: as `timeline` gives it."""
    if not loops and until is None:
        raise ValueError("a sequence that plays forever needs an end")
    whole = timeline.groupBy("anim").agg(F.sum("delay").alias("whole"))
    times = F.lit(loops).cast("long") if loops else F.greatest(F.ceil(F.lit(until) / F.col("whole")), F.lit(1)).cast("long")
    every = timeline.join(whole, "anim").withColumn("loop", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    out = every.select("anim", "loop", "frame", (F.col("start") + F.col("loop") * F.col("whole")).alias("start"))
    return out.filter(F.col("start") < until) if until is not None else out


def patches(frames: DataFrame, width: int = 2) -> DataFrame:
    """anim, frame, y, x, key: `width` by 2 samples from each place."""
    below = frames.select("anim", "frame", (F.col("y") - 1).alias("y"), F.col("line").alias("low"))
    both = frames.join(below, ["anim", "frame", "y"]).withColumn("x", F.explode(F.expr(f"sequence(0, size(line) - {width})")))
    return both.select("anim", "frame", "y", "x", F.concat(F.slice("line", F.col("x") + 1, F.lit(width)), F.slice("low", F.col("x") + 1, F.lit(width))).alias("key"), F.expr("line[x]").alias("v"))


def move_votes(frames: DataFrame, least: int = 4, width: int = 2) -> DataFrame:
    """anim, frame, dx, dy, votes: how many changed places hold a patch that the frame before holds just once, elsewhere."""
    all_ = patches(frames, width)
    once = all_.groupBy("anim", "frame", "key").agg(F.count("*").alias("n"), F.min(F.struct("y", "x")).alias("at")).filter("n = 1")
    old = once.select("anim", (F.col("frame") + 1).alias("frame"), "key", F.col("at.y").alias("oy"), F.col("at.x").alias("ox"))
    was = all_.select("anim", (F.col("frame") + 1).alias("frame"), "y", "x", F.col("v").alias("was"))
    moved = all_.join(was, ["anim", "frame", "y", "x"]).filter("v <> was").join(old, ["anim", "frame", "key"])
    votes = moved.select("anim", "frame", (F.col("x") - F.col("ox")).alias("dx"), (F.col("y") - F.col("oy")).alias("dy")).filter("dx <> 0 OR dy <> 0")
    return votes.groupBy("anim", "frame", "dx", "dy").agg(F.count("*").alias("votes")).filter(F.col("votes") >= least)
