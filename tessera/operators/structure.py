"""Dictionaries, runs, scan orders, periodic models, patterns and blocks of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import formulas as f
from tessera.operators.neighbors import BAND

#: Ranks of a sample in the eight scan orders; w and h are the image's width and height.
SHEARS = (1, -1, 2, -2)
ORDERS = [
    "y * w + x", "x * h + y", *(f"((x - ({k} * y)) % w + w) % w * h + y" for k in SHEARS),
    "y * w + CASE WHEN y % 2 = 1 THEN w - 1 - x ELSE x END", "x * h + CASE WHEN x % 2 = 1 THEN h - 1 - y ELSE y END",
]
#: Ranks of a scan order that are put in order together.
SPAN = 1 << 16
#: Block operations by name.
BLOCK_OPS = {"raw": 0, "flat": 1, "left": 2, "up": 3, "two": 4, "four": 5, "patterns": 6, "earlier": 7}


def palette(colours: DataFrame, most: int = 65_536) -> DataFrame:
    """img, idx, r, g, b, a and n: an image's colours in order of r, g, b, a. Images with more than `most` colours have no palette; they are left
    out before anything is ordered."""
    kinds = _few(colours.groupBy("img", "r", "g", "b", "a").agg(F.count("*").alias("n")), most)
    return kinds.withColumn("idx", F.row_number().over(W.partitionBy("img").orderBy("r", "g", "b", "a")) - 1)


def _few(kinds: DataFrame, most: int) -> DataFrame:
    """Colours of images that have at most `most`."""
    small = kinds.groupBy("img").agg(F.count("*").alias("_size")).filter(F.col("_size") <= most)
    return kinds.join(small.select("img"), "img", "left_semi")


def palette_by_luma(colours: DataFrame, most: int = 256) -> DataFrame:
    """The same in order of 2r + 5g + b, ties by first appearance in line order."""
    kinds = _few(colours.groupBy("img", "r", "g", "b", "a").agg(F.count("*").alias("n"), F.min(F.struct("y", "x")).alias("_first")), most)
    return kinds.withColumn("idx", F.row_number().over(W.partitionBy("img").orderBy(F.expr("2 * r + 5 * g + b"), "_first")) - 1).drop("_first")


def indexed(colours: DataFrame, palette: DataFrame) -> DataFrame:
    """Pixels with their place in the palette: img, y, x, idx. The join is by image and colour; Spark broadcasts a palette only if it is small."""
    return colours.join(palette.select("img", "r", "g", "b", "a", "idx"), ["img", "r", "g", "b", "a"]).select("img", "y", "x", "idx")


def runs(rows: DataFrame) -> DataFrame:
    """img, y, x, v, n: runs of equal samples in line order, across line ends.

    Runs inside a line are complete and aren't exchanged. Only a line's first and last run, a row for each line, go through an order over the
    image: a line that begins with the sample that the one above ended with goes on, and one of a single run passes it down."""
    starts = F.expr("filter(sequence(0, size(line) - 1), i -> i = 0 OR line[i] <> line[i - 1])")
    lines = rows.filter(F.size("line") > 0).select("img", "y", "line", F.size("line").alias("w"), starts.alias("s"))
    inner = lines.filter(F.size("s") > 2).select("img", "y", "line", "s", F.posexplode(F.expr("slice(s, 2, size(s) - 2)")).alias("k", "x"))
    inner = inner.select("img", "y", "x", F.expr("line[x]").alias("v"), F.expr("CAST(s[k + 2] - x AS BIGINT)").alias("n"))
    ends = lines.select("img", "y", (F.size("s") == 1).alias("one"), F.expr("line[0]").alias("v0"), F.expr("coalesce(get(s, 1), w)").alias("n0"), F.expr("line[w - 1]").alias("v1"), F.expr("s[size(s) - 1]").alias("x1"), F.expr("w - s[size(s) - 1]").alias("n1"))
    down = W.partitionBy("img").orderBy("y")
    ends = ends.withColumn("on", F.coalesce(F.lag("v1").over(down) == F.col("v0"), F.lit(False)))
    # a chain is the last run of a line and all that goes on from it: whole lines, and the first run of the line that ends it
    ends = ends.withColumn("chain", F.sum(F.when(F.col("on") & F.col("one"), 0).otherwise(1)).over(down))
    first = F.struct(F.when(F.col("on"), F.col("chain") - 1).alias("chain"), F.lit(0).alias("x"), F.col("v0").alias("v"), F.col("n0").cast("long").alias("n"))
    last = F.struct(F.col("chain"), F.col("x1").alias("x"), F.col("v1").alias("v"), F.col("n1").cast("long").alias("n"))
    ends = ends.select("img", "y", F.explode(F.when(F.col("one"), F.array(last)).otherwise(F.array(first, last))).alias("r")).select("img", "y", "r.*")
    place = F.struct("y", "x")
    chained = ends.filter("chain IS NOT NULL").groupBy("img", "chain").agg(F.min(place).alias("at"), F.min_by("v", place).alias("v"), F.sum("n").alias("n"))
    alone = ends.filter("chain IS NULL").select("img", "y", "x", "v", "n")
    return inner.unionByName(alone).unionByName(chained.select("img", "at.y", "at.x", "v", "n"))


def events(residuals: DataFrame, rank: str, w: int, h: int) -> DataFrame:
    """img, rank, skip, e: residuals other than 0 in a scan order and how many zeros lie before each.

    Ranks are dealt in parts of SPAN, each ordered by itself; only a part's last rank, a row for each part, is ordered over the image."""
    r = F.expr(f.spark(f.named(rank, w=w, h=h))).cast("long").alias("rank")
    some = residuals.filter("e <> 0").select("img", r, "e").withColumn("part", F.expr(f"rank div {SPAN}"))
    lasts = some.groupBy("img", "part").agg(F.max("rank").alias("last"))
    before = lasts.select("img", "part", F.lag("last").over(W.partitionBy("img").orderBy("part")).alias("before"))
    inside = F.lag("rank").over(W.partitionBy("img", "part").orderBy("rank"))
    skip = F.col("rank") - F.coalesce(F.col("inside"), F.col("before"), F.lit(-1)) - 1
    return some.withColumn("inside", inside).join(before, ["img", "part"]).select("img", "rank", "e", skip.alias("skip"))


def run_cost(text: str) -> str:
    return f"(CASE WHEN {text} = 0 THEN 1 ELSE 2 * ({f.bits(text, 24)}) END)"


def order_costs(residuals: DataFrame, w: int, h: int) -> DataFrame:
    """img, scan, n, cost and best for the eight scan orders; ties to the lowest number. Parts of SPAN ranks are priced by themselves and joined at
    their ends, so no image is one task."""
    ranks = F.array(*(F.expr(f.spark(f.named(r, w=w, h=h))).cast("long") for r in ORDERS))
    some = residuals.filter("e <> 0").select("img", "e", F.posexplode(ranks).alias("scan", "rank")).withColumn("part", F.expr(f"rank div {SPAN}"))
    inside = some.withColumn("skip", F.col("rank") - F.lag("rank").over(W.partitionBy("img", "scan", "part").orderBy("rank")) - 1)
    cost = F.sum(F.expr(f"CASE WHEN skip IS NULL THEN 0 ELSE {run_cost('skip')} END + {run_cost('(abs(e) - 1)')} + 1"))
    parts = inside.groupBy("img", "scan", "part").agg(F.count("*").alias("n"), cost.alias("c"), F.min("rank").alias("first"), F.max("rank").alias("last"))
    before = F.lag("last").over(W.partitionBy("img", "scan").orderBy("part"))
    parts = parts.withColumn("skip", F.col("first") - F.coalesce(before, F.lit(-1)) - 1)
    totals = parts.groupBy("img", "scan").agg(F.sum("n").alias("n"), F.sum(F.col("c") + F.expr(run_cost("skip"))).alias("c"))
    totals = totals.withColumn("cost", F.expr(f"c + 4 + {run_cost('n')}")).drop("c")
    return totals.withColumn("best", F.row_number().over(W.partitionBy("img").orderBy("cost", "scan")) == 1)


def separable(samples: DataFrame) -> DataFrame:
    """img, pixels, mismatches and separable: whether each sample is its column's first plus its line's first minus the origin, mod 256."""
    row, column, origin = (samples.filter(c) for c in ("y = 0", "x = 0", "y = 0 AND x = 0"))
    joined = samples.join(row.select("img", "x", F.col("v").alias("rv")), ["img", "x"]).join(column.select("img", "y", F.col("v").alias("cv")), ["img", "y"])
    joined = joined.join(origin.select("img", F.col("v").alias("ov")), "img")
    wrong = F.count_if(F.expr("((rv + cv - ov) & 255) <> v"))
    return joined.groupBy("img").agg(F.count("*").alias("pixels"), wrong.alias("mismatches"), (wrong == 0).alias("separable"))


def separable_deltas(samples: DataFrame) -> DataFrame:
    """img, side, i, delta: differences along the first line and the first column."""
    row = samples.filter("y = 0").select("img", F.lit("row").alias("side"), F.col("x").alias("i"), "v")
    column = samples.filter("x = 0").select("img", F.lit("column").alias("side"), F.col("y").alias("i"), "v")
    sides = row.unionByName(column)
    before = sides.select("img", "side", (F.col("i") + 1).alias("i"), F.col("v").alias("before"))  # a join: a side may be as long as the table
    return sides.join(before, ["img", "side", "i"], "left").select("img", "side", "i", F.expr("(v - coalesce(before, 0)) & 255").alias("delta"))


def slopes(rows: DataFrame, period: int) -> DataFrame:
    """img, slope, cost: the factor a whose a * period is nearest to the differences of samples `period` apart; ties to the lowest."""
    d = rows.select("img", F.explode(F.expr(f"transform(filter(sequence(0, size(line) - 1), i -> i >= {period}), i -> (line[i] - line[i - {period}]) & 255)")).alias("d"))
    hist = d.groupBy("img", "d").agg(F.count("*").alias("n"))
    circle = f"least((d - a * {period}) & 255, 256 - ((d - a * {period}) & 255))"
    each = hist.select("img", "d", "n", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("a")).withColumn("c", F.expr(circle) * F.col("n"))
    costs = each.groupBy("img", "a").agg(F.sum("c").alias("cost"))
    return costs.groupBy("img").agg(F.min(F.struct("cost", "a")).alias("m")).select("img", F.col("m.a").alias("slope"), "m.cost")


def phases(samples: DataFrame, period: int, a: int, b: int) -> DataFrame:
    """img, py, px, v, n: the commonest rest of v - a x - b y at each place of a period; ties to the lowest."""
    rest = samples.select("img", F.expr(f"y % {period}").alias("py"), F.expr(f"x % {period}").alias("px"), F.expr(f"(v - {a} * x - {b} * y) & 255").cast("int").alias("v"))
    counts = rest.groupBy("img", "py", "px", "v").agg(F.count("*").alias("n"))
    return counts.groupBy("img", "py", "px").agg(F.min(F.struct(-F.col("n"), "v")).alias("m")).select("img", "py", "px", F.col("m.v").alias("v"), (-F.col("m.col1")).alias("n"))


def patterns(rows: DataFrame, most: int = 127) -> DataFrame:
    """img, token, v0 to v3 and n: the commonest 2 by 2 patterns that occur twice or more, by count and then first appearance. An
    odd last line or column is repeated. Images of which they cover less than a quarter have none."""
    pairs = rows.select("img", F.expr("y div 2").alias("ty"), F.expr("y % 2").alias("half"), "line")
    two = pairs.groupBy("img", "ty").agg(F.max(F.when(F.col("half") == 0, F.col("line"))).alias("top"), F.max(F.when(F.col("half") == 1, F.col("line"))).alias("low"))
    two = two.withColumn("low", F.coalesce("low", "top")).withColumn("tx", F.explode(F.expr("sequence(0, (size(top) - 1) div 2)")))
    at = lambda line, i: F.expr(f"get({line}, least(2 * tx + {i}, size(top) - 1))")
    cells = two.select("img", "ty", "tx", at("top", 0).alias("v0"), at("top", 1).alias("v1"), at("low", 0).alias("v2"), at("low", 1).alias("v3"))
    kinds = cells.groupBy("img", "v0", "v1", "v2", "v3").agg(F.count("*").alias("n"), F.min(F.struct("ty", "tx")).alias("first"))
    total = F.sum("n").over(W.partitionBy("img"))
    token = F.row_number().over(W.partitionBy("img").orderBy(F.col("n").desc(), "first"))
    chosen = kinds.withColumns({"blocks": total, "token": token}).filter(f"n > 1 AND token <= {most}")
    enough = F.sum("n").over(W.partitionBy("img")) * 4 >= F.col("blocks")
    return chosen.withColumn("_ok", enough).filter("_ok").select("img", "token", "v0", "v1", "v2", "v3", "n")


def blocks(rows: DataFrame, size: int = 16) -> DataFrame:
    """img, ty, tx, bw, bh and cells (samples of a block in line order)."""
    cut = rows.select("img", F.expr(f"y div {size}").alias("ty"), "y", "line", F.explode(F.expr(f"sequence(0, (size(line) - 1) div {size})")).alias("tx"))
    part = cut.select("img", "ty", "tx", "y", F.slice("line", F.col("tx") * size + 1, F.lit(size)).alias("part"))
    whole = part.groupBy("img", "ty", "tx").agg(F.array_sort(F.collect_list(F.struct("y", "part"))).alias("p"))
    return whole.select("img", "ty", "tx", F.size(F.expr("p[0].part")).alias("bw"), F.size("p").alias("bh"), F.flatten(F.transform("p", lambda s: s["part"])).alias("cells"))


def _equal_to(blocks: DataFrame, dy: int, dx: int, name: str) -> DataFrame:
    other = blocks.select("img", (F.col("ty") + dy).alias("ty"), (F.col("tx") + dx).alias("tx"), F.col("bw").alias("_w"), F.col("bh").alias("_h"), F.col("cells").alias("_c"))
    same = F.coalesce((F.col("cells") == F.col("_c")) & (F.col("bw") == F.col("_w")) & (F.col("bh") == F.col("_h")), F.lit(False))
    return blocks.join(other, ["img", "ty", "tx"], "left").withColumn(name, same).drop("_w", "_h", "_c")


def earlier_blocks(blocks: DataFrame, across: str) -> DataFrame:
    """blocks with `number` (in line order, `across` to a line) and `distance` to the latest earlier block of equal content, null if none."""
    numbered = blocks.withColumn("number", F.col("ty") * F.expr(across) + F.col("tx"))
    # a row for each content and part of SPAN numbers, so that a flat ground is many rows; only parts are ordered over the image
    same = ["img", "_same", "bw", "bh"]
    rest = [c for c in blocks.columns if c not in ("img", "bw", "bh", "cells")]
    one = numbered.select("img", "bw", "bh", "cells", F.sha2(F.col("cells").cast("string"), 256).alias("_same"), F.expr(f"number div {SPAN}").alias("_part"), F.struct("number", *rest).alias("_b"))
    parts = one.groupBy(*same, "_part").agg(F.first("cells").alias("cells"), F.array_sort(F.collect_list("_b")).alias("_all"))
    parts = parts.withColumn("_before", F.lag(F.element_at("_all", -1)["number"]).over(W.partitionBy(*same).orderBy("_part")))
    apart = F.expr("transform(_all, (b, i) -> struct(b AS b, b.number - coalesce(get(_all, i - 1).number, _before) AS distance))")
    out = parts.select("img", "bw", "bh", "cells", F.explode(apart).alias("_f")).select("img", "bw", "bh", "cells", "_f.b.*", "_f.distance")
    return out.select(*blocks.columns, "number", "distance")


def block_ops(blocks: DataFrame, across: str) -> DataFrame:
    """img, ty, tx, op, bytes: the cheapest way to write each block of one channel, in the order that settles ties."""
    found = _equal_to(_equal_to(earlier_blocks(blocks, across), 0, 1, "left"), 1, 0, "up")
    area, colours = "(bw * bh)", "array_size(array_distinct(cells))"
    tops = "filter(sequence(0, (bh - 1) div 2), i -> true)"
    pats = f"array_size(array_distinct(flatten(transform({tops}, py -> transform(sequence(0, (bw - 1) div 2), px -> struct(cells[2 * py * bw + 2 * px], cells[2 * py * bw + least(2 * px + 1, bw - 1)], cells[least(2 * py + 1, bh - 1) * bw + 2 * px], cells[least(2 * py + 1, bh - 1) * bw + least(2 * px + 1, bw - 1)]))))))"
    found = found.withColumns({"colours": F.expr(colours), "pats": F.expr(pats), "subs": F.expr("((bw + 1) div 2) * ((bh + 1) div 2)"), "area": F.expr(area)})
    return found.select("img", "ty", "tx", *(F.expr(f.spark(t)).alias(n) for n, t in block_choice().items()))


def block_choice() -> dict[str, str]:
    """Operation and bytes from area, colours, pats, subs, left, up and distance, as formulas."""
    width = lambda n: "(" + f.bits(f"({n} - 1)", 5) + ")"
    two, four = "(3 + (area + 7) // 8)", f"(2 + colours + (area * {width('colours')} + 7) // 8)"
    pats = f"(2 + 4 * pats + (subs * {width('pats')} + 7) // 8)"
    base = "CASE WHEN up OR left THEN 1 WHEN colours = 1 THEN 2 ELSE 1 + area END"
    first = f"CASE WHEN colours = 2 THEN least({base}, {two}) WHEN colours IN (3, 4) THEN least({base}, {four}) ELSE {base} END"
    name = f"CASE WHEN colours = 2 AND {two} < {base} THEN 'two' WHEN colours IN (3, 4) AND {four} < {base} THEN 'four' WHEN up THEN 'up' WHEN left THEN 'left' WHEN colours = 1 THEN 'flat' ELSE 'raw' END"
    ref = "(1 + CASE WHEN distance < 128 THEN 1 WHEN distance < 16384 THEN 2 WHEN distance < 2097152 THEN 3 ELSE 4 END)"
    by_pats, by_ref = f"(pats > 1 AND pats <= 16 AND {pats} < ({first}))", f"(distance IS NOT NULL AND {ref} < ({first}))"
    return {
        "op": f"CASE WHEN {by_ref} THEN 'earlier' WHEN {by_pats} THEN 'patterns' ELSE {name} END",
        "bytes": f"CASE WHEN {by_ref} THEN {ref} WHEN {by_pats} THEN {pats} ELSE {first} END",
    }


def block_residual_scores(stencil: DataFrame, size: int = 16) -> DataFrame:
    """img, ty, tx, op, score: zero, flat (rounded mean) or causal prediction, whichever leaves the least sum of residual classes."""
    at = (F.expr(f"y div {size}").alias("ty"), F.expr(f"x div {size}").alias("tx"))
    counts = stencil.groupBy("img", *at, "v").agg(F.count("*").alias("n"))
    mean = counts.groupBy("img", "ty", "tx").agg(F.expr("(sum(v * n) + sum(n) div 2) div sum(n)").alias("mean"))
    flat = counts.join(mean, ["img", "ty", "tx"]).groupBy("img", "ty", "tx").agg(F.sum(F.expr(f"{size_class('v - mean')} * n")).alias("flat"), F.sum(F.expr(f"{size_class('v')} * n")).alias("zero"))
    causal = stencil.groupBy("img", *at).agg(F.sum(F.expr(size_class(f"v - ({CAUSAL})"))).alias("causal"))
    both = flat.join(causal, ["img", "ty", "tx"])
    scores = F.array(F.struct((F.col("zero") + 20).alias("score"), F.lit(0).alias("op")), F.struct((F.col("flat") + 40).alias("score"), F.lit(1).alias("op")), F.struct((F.col("causal") + 20).alias("score"), F.lit(5).alias("op")))
    return both.withColumn("m", F.array_min(scores)).select("img", "ty", "tx", F.col("m.op").alias("op"), F.col("m.score").alias("score"))


#: Paeth over the neighbours, 0 for the first sample of an image (where all neighbours stand in for none).
CAUSAL = f"CASE WHEN x = 0 AND y = 0 THEN 0 ELSE {f.PAETH} END"


def size_class(text: str) -> str:
    """0 to 8 by the wrapped size of a difference of bytes."""
    d = f"least(({text}) & 255, 256 - (({text}) & 255))"
    return f"(CASE WHEN {d} = 0 THEN 0 " + " ".join(f"WHEN {d} <= {(1 << k) - 1} THEN {k}" for k in range(1, 8)) + " ELSE 8 END)"


def prefix_sums(rows: DataFrame) -> DataFrame:
    """img, y, x, s: the sum of all samples up to a place, both ways. Lines are dealt in bands; sums down a column go on from the sums of the
    bands above, which are a row for each band and column, and a running sum along each line comes last."""
    cells = rows.select("img", "y", F.expr(f"y div {BAND}").alias("band"), F.posexplode("line").alias("x", "v"))
    bands = cells.groupBy("img", "band", "x").agg(F.sum("v").alias("total"))
    above = F.sum("total").over(W.partitionBy("img", "x").orderBy("band").rowsBetween(W.unboundedPreceding, -1))
    bands = bands.select(F.col("img").alias("_img"), F.col("band").alias("_band"), F.col("x").alias("_x"), F.coalesce(above, F.lit(0)).alias("above"))
    down = cells.withColumn("d", F.sum("v").over(W.partitionBy("img", "band", "x").orderBy("y")))
    down = down.join(bands, (F.col("img") == F.col("_img")) & (F.col("band") == F.col("_band")) & (F.col("x") == F.col("_x")))
    return down.select("img", "y", "x", F.sum(F.col("d") + F.col("above")).over(W.partitionBy("img", "y").orderBy("x")).alias("s"))
