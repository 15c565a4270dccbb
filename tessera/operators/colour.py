"""Colour: the 36 reversible transforms, sample modes, image flags and transform ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import formulas as f
from tessera.operators.neighbors import with_lines_above

#: Order in which equal scores are settled.
RANKING = [2, 9, 10, 5, 6, 3, 1, 7, 8, 0, 4, *range(11, 36)]
#: Projections of a pixel by name; differences wrap at 256.
MODES = {
    "gray": ("r", "0", "0"), "rgb": ("r", "g", "b"), "green": ("g", "(r - g) & 255", "(b - g) & 255"),
    "red": ("r", "(g - r) & 255", "(b - r) & 255"), "blue": ("b", "(r - b) & 255", "(g - b) & 255"),
}


def transformed(colours: DataFrame, t: int) -> DataFrame:
    """colours with planes p, q and s of transform t."""
    return colours.withColumns({n: F.expr(e) for n, e in zip("pqs", f.transform(t))})


def restored(planes: DataFrame, t: int) -> DataFrame:
    """planes with the colours (r2, g2, b2) that the inverse of transform t gives."""
    return planes.withColumns({n: F.expr(e) for n, e in zip(("r2", "g2", "b2"), f.inverse(t))})


def plane_sums(colours: DataFrame) -> DataFrame:
    """t, s0, s1, s2: sums of every transform's planes, in one pass."""
    cells = [F.struct(*(F.sum(F.expr(e)).alias(n) for n, e in zip(("s0", "s1", "s2"), f.transform(t)))) for t in range(36)]
    return colours.agg(F.array(*cells).alias("c")).select(F.posexplode("c").alias("t", "c")).select("t", "c.*")


def round_trips(colours: DataFrame) -> DataFrame:
    """t and mismatches: pixels that a transform and its inverse change."""
    cells = []
    for t in range(36):
        p = dict(zip("pqs", (f"({e})" for e in f.transform(t))))
        back = [f.named(e, **p) for e in f.inverse(t)]
        cells.append(F.count_if(F.expr(f"({back[0]}) <> r OR ({back[1]}) <> g OR ({back[2]}) <> b")))
    return colours.agg(F.array(*cells).alias("c")).select(F.posexplode("c").alias("t", "mismatches"))


def mode_sums(colours: DataFrame) -> DataFrame:
    """mode, s0, s1, s2: sums of every sample mode's channels."""
    cells = [F.struct(F.lit(m).alias("mode"), *(F.sum(F.expr(e)).cast("long").alias(n) for n, e in zip(("s0", "s1", "s2"), es))) for m, es in MODES.items()]
    return colours.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def on_grid(v: str, depth: int) -> str:
    """Whether a sample lies on the scaling grid of `depth` bits."""
    m = (1 << depth) - 1
    return f"{v} = ((({v} * {m} + 127) // 255) * 255 + {m // 2}) // {m}"


def image_flags(colours: DataFrame) -> DataFrame:
    """img, pixels, opaque, is_gray, constant_alpha and depth: the fewest bits from 1 to 7 on whose grid all samples lie, else 8."""
    every = [F.expr("bool_and(" + f.spark(" AND ".join(on_grid(c, d) for c in "rgb")) + ")") for d in range(1, 8)]
    depth = F.coalesce(*(F.when(ok, F.lit(d)) for d, ok in enumerate(every, 1)), F.lit(8))
    return colours.groupBy("img").agg(
        F.count("*").alias("pixels"), F.expr("min(a) = 255").alias("opaque"), F.expr("bool_and(r = g AND g = b)").alias("is_gray"),
        F.expr("min(a) = max(a)").alias("constant_alpha"), depth.alias("depth"),
    )


def planes() -> list[str]:
    """Every distinct plane of the transforms."""
    return list(dict.fromkeys(e for t in range(36) for e in f.transform(t)))


def ranked_transforms(rows: DataFrame, width: int, height: int) -> DataFrame:
    """t, cost and place: the sum of MED costs of each transform's planes over a grid of at most 192 by 128 pixels; place 1 is the cheapest, ties in the
    order of RANKING. Costs are taken once for each distinct plane."""
    xs, ys = -(-width // 192), -(-height // 128)
    lines = with_lines_above(rows, "r", "g", "b", reach=1).filter(F.col("y") % ys == 0)
    cells = lines.select("img", "y", *"rgb", *(f"{c}_up" for c in "rgb"), F.posexplode("r").alias("x", "r0")).filter(F.col("x") % xs == 0)
    places = {"0": ("{c}", "x"), "W": ("{c}", "x - 1"), "N": ("{c}_up", "x"), "NW": ("{c}_up", "x - 1"), "NE": ("{c}_up", "x + 1")}
    near = cells.select(*(F.expr(f"get({line.format(c=c)}, {at})").alias(f"{c}{name}") for name, (line, at) in places.items() for c in "rgb"))
    # every plane at each place, then a row for each plane: the formulas appear once for each place
    at = lambda n: F.array(*(F.expr(f.named(e, **{c: f"{c}{n}" for c in "rgb"})) for e in planes()))
    top = F.array(*(F.lit(511 if e.endswith("+ 256") else 255) for e in planes()))
    lists = near.select(top.alias("m"), *(at(n).alias(k) for n, k in (("0", "v"), ("W", "w"), ("N", "n"), ("NW", "nw"), ("NE", "ne"))))
    cells = lists.select(F.posexplode(F.arrays_zip("m", "v", "w", "n", "nw", "ne")).alias("plane", "c")).select("plane", "c.*")
    north = "coalesce(n, w, (m + 1) >> 1)"
    near = {"W": "coalesce(w, n, (m + 1) >> 1)", "N": north, "NW": f"coalesce(nw, {north})", "NE": f"coalesce(ne, {north})"}
    cells = cells.select("plane", "m", "v", *(F.expr(e).alias(k + "_") for k, e in near.items()))
    med = f.named(f.cost(f"abs({f.residual('v', f.MED)})"), M="m", W="W_", N="N_", NW="NW_", NE="NE_")
    costs = cells.groupBy("plane").agg(F.sum(F.expr(med)).alias("cost"))
    index = {e: i for i, e in enumerate(planes())}
    of = [(index[e], t, RANKING.index(t)) for t in range(36) for e in f.transform(t)]
    uses = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(t).alias("t"), F.lit(r).alias("r")) for p, t, r in of))
    totals = costs.select("plane", "cost", F.explode(uses).alias("u")).filter("plane = u.p").groupBy("u.t", "u.r").agg(F.sum("cost").alias("cost"))
    return totals.select("t", "cost", F.row_number().over(W.orderBy("cost", "r")).alias("place"))
