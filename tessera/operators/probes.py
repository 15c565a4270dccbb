"""Probes and gates: cheap looks at an image that decide which ways of coding are worth a try."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.structure import _equal_to, earlier_blocks

#: Blocks sampled along a side before steps grow, blocks looked at in all and at least, part of them that must be useful.
SIDE, MOST, LEAST, PART = 48, 4096, 16, 8


def gray_kinds(rows: DataFrame, most: int = 256) -> DataFrame:
    """img, kinds and few: distinct samples, and whether they are at most `most`. Lines give their distinct samples before the exchange."""
    kinds = rows.select("img", F.explode(F.array_distinct("line")).alias("v")).distinct()
    return kinds.groupBy("img").agg(F.count("*").alias("kinds")).withColumn("few", F.col("kinds") <= most)


def colour_kinds(colours: DataFrame, most: int = 256) -> DataFrame:
    """img, kinds and few: distinct colours. Nothing is ordered, so an image of any number of colours is many tasks."""
    kinds = colours.select("img", "r", "g", "b", "a").distinct()
    return kinds.groupBy("img").agg(F.count("*").alias("kinds")).withColumn("few", F.col("kinds") <= most)


def block_probe(blocks: DataFrame, across: int) -> DataFrame:
    """img, sampled, useful and worth: of sampled blocks those that are flat, equal to the block left, above or an earlier sampled one, or of at
    most four samples; worth a try from an eighth. blocks: as `structure.blocks` gives them, `across` to a line."""
    down = blocks.groupBy("img").agg((F.max("ty") + 1).alias("down"))
    found = _equal_to(_equal_to(blocks, 0, 1, "left"), 1, 0, "up").join(down, "img")
    xs = max(across // SIDE, 1)
    ys = f"greatest(down div {SIDE}, 1)"
    rank = f"ty div {ys} * {-(-across // xs)} + tx div {xs}"
    found = found.filter(F.expr(f"tx % {xs} = 0 AND ty % {ys} = 0 AND {rank} < {MOST}"))
    found = earlier_blocks(found, str(across))
    useful = F.expr("left OR up OR distance IS NOT NULL OR array_size(array_distinct(cells)) <= 4")
    counts = found.groupBy("img").agg(F.count("*").alias("sampled"), F.count_if(useful).alias("useful"))
    return counts.withColumn("worth", F.expr(f"(sampled >= {LEAST} OR sampled = {MOST}) AND useful * {PART} >= sampled"))


def explicit_ids(tiles: DataFrame) -> DataFrame:
    """img, tiles, explicit and worth: tiles whose predictor follows neither from the tile left nor from that above, and whether they are a
    quarter or more. tiles: img, ty, tx, id. Tiles meet their neighbours by key."""
    at = lambda dy, dx, name: tiles.select("img", (F.col("ty") + dy).alias("ty"), (F.col("tx") + dx).alias("tx"), F.col("id").alias(name))
    both = tiles.join(at(0, 1, "left"), ["img", "ty", "tx"], "left").join(at(1, 0, "up"), ["img", "ty", "tx"], "left")
    told = F.expr("coalesce(id = left, false) OR coalesce(id = up AND (left IS NULL OR up <> left), false)")
    return both.groupBy("img").agg(F.count("*").alias("tiles"), F.count_if(~told).alias("explicit")).withColumn("worth", F.expr("explicit * 100 >= tiles * 25"))


def phase_matches(phases: DataFrame, pixels: DataFrame, most: int = 2_097_152) -> DataFrame:
    """img, matches, pixels and worth: samples that a periodic model of the commonest rests gives, and whether they are nine tenths of an image
    that isn't too large. phases: as `structure.phases` gives them; pixels: img and pixels."""
    sums = phases.groupBy("img").agg(F.sum("n").alias("matches"))
    return sums.join(pixels, "img").withColumn("worth", F.expr(f"matches * 10 >= pixels * 9 AND pixels <= {most}"))


def block_bases(blocks: DataFrame) -> DataFrame:
    """img, ty, tx, base and n: the commonest sample of each block, ties to the lowest."""
    counts = F.transform(F.array_distinct("cells"), lambda v: F.struct((-F.size(F.filter("cells", lambda c: c == v))).alias("n"), v.alias("v")))
    return blocks.withColumn("m", F.array_min(counts)).select("img", "ty", "tx", F.col("m.v").alias("base"), (-F.col("m.n")).alias("n"))


#: Whether a slow coder is worth a run after a quick one, from the sizes payload, proxy (of the quick coder's output), total (of the whole file
#: with it) and incumbent. An eighth of the payload, three fifths above the incumbent.
WORTH_A_RUN = "(proxy <= payload // 8 OR total <= incumbent OR (incumbent > 0 AND total // greatest(incumbent, 1) = 1 AND total - incumbent <= incumbent // 5 * 3 + incumbent % 5 * 3 // 5))"


def region(rows: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The rectangle's lines, counted from 0. Lines outside are never read where files tell their range of y."""
    return rows.filter((F.col("y") >= y) & (F.col("y") < y + h)).withColumns({"y": F.col("y") - y, "line": F.slice("line", x + 1, w)})
