"""Block prediction as SQL: parameters of every operation, scores, and mixtures by five coordinates.

The formulas read the sample v, its neighbours W, N and NW, its place x and y, `beside` and `above` (the samples one block left and up,
null where there is no such block) and a block's parameters. They are text that another engine runs as it stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import formulas as f
from tessera.operators.neighbors import stencil
from tessera.operators.structure import CAUSAL, size_class

SIZE = 16
#: What a block pays for its operation and for each parameter.
PRICE = 20
#: Parameters of zero, flat, gradient, left, up, causal and mixture, for one channel.
PARAMETERS = (0, 1, 4, 1, 1, 0, 10)
#: The coordinates tried beside those that the scores tell, in this order. q0 to q4 are the latter.
TRIALS = (
    ("q0", "q1", "q2", "q3", "q4"), ("15", "q1", "0", "q3", "q4"), ("15", "q1", "15", "q3", "q4"), ("0", "15", "q2", "0", "q4"), ("0", "0", "q2", "0", "q4"),
    ("0", "q1", "q2", "15", "0"), ("0", "q1", "q2", "15", "15"), ("8", "q1", "q2", "8", "q4"), ("greatest(q0 - 2, 0)", "q1", "q2", "q3", "q4"),
    ("least(q0 + 2, 15)", "q1", "q2", "q3", "q4"), ("q0", "q1", "greatest(q2 - 2, 0)", "q3", "q4"), ("q0", "q1", "least(q2 + 2, 15)", "q3", "q4"),
    ("q0", "q1", "q2", "greatest(q3 - 2, 0)", "q4"), ("q0", "q1", "q2", "least(q3 + 2, 15)", "q4"),
)


def _byte(text: str) -> str:
    return f"greatest(0, least(255, {text}))"


def _between(a: str, b: str, at: str, last: str) -> str:
    return f"(CASE WHEN {last} > 0 THEN ({a} * ({last} - {at}) + {b} * {at} + {last} // 2) // greatest({last}, 1) ELSE {a} END)"


def _lerp(a: str, b: str, q: str) -> str:
    return f"(({a} * (15 - ({q})) + {b} * ({q}) + 7) // 15)"


def step(other: str) -> str:
    """Difference to another sample, the shorter way round."""
    return f"(CASE WHEN v - {other} > 128 THEN v - {other} - 256 WHEN v - {other} < -128 THEN v - {other} + 256 ELSE v - {other} END)"


def mean_step(total: str, n: str) -> str:
    """Rounded mean of differences, halves away from 0, as a signed byte."""
    return f"greatest(-128, least(127, CASE WHEN {total} >= 0 THEN ({total} + {n} // 2) // {n} ELSE -((-({total}) + {n} // 2) // {n}) END))"


_DX, _DY = f"(x % {SIZE})", f"(y % {SIZE})"
PLANE = f"CASE WHEN x > 0 AND y > 0 THEN {_byte('W + N - NW')} ELSE {CAUSAL} END"
GRADIENT = _between(_between("c0", "c1", _DX, "(bw - 1)"), _between("c2", "c3", _DX, "(bw - 1)"), _DY, "(bh - 1)")
LEFT, UP = _byte("beside + dleft"), _byte("above + dup")
#: Predictions whose scores give the coordinates; null where there is no block beside or above.
SINGLE = {"zero": "0", "flat": "flat", "gradient": GRADIENT, "left": LEFT, "up": UP, "causal": f"({CAUSAL})", "plane": f"({PLANE})"}


def mixture(q: tuple[str, ...]) -> str:
    """The mixture's prediction from columns with the names of SINGLE."""
    beside, above = "coalesce(p_left, p_causal)", "coalesce(p_up, p_causal)"
    around = _lerp(_lerp(above, beside, q[1]), _lerp("p_causal", "p_plane", q[4]), q[3])
    return _lerp(around, _lerp("p_flat", "p_gradient", q[2]), q[0])


def pair(a: str, b: str) -> str:
    """0 to 15, the nearer to 15 the more a is above b; a missing score is worse than any."""
    return f"(CASE WHEN {a} IS NULL AND {b} IS NULL THEN 8 WHEN {a} IS NULL THEN 15 WHEN {b} IS NULL THEN 0 WHEN {a} + {b} = 0 THEN 8 ELSE least(15, ({a} * 15 + ({a} + {b}) // 2) // greatest({a} + {b}, 1)) END)"


def coordinates() -> dict[str, str]:
    """q0 to q4 from the scores s_flat .. s_plane. Left and up pay for a mixture's parameters here."""
    price = lambda op: PRICE * (1 + PARAMETERS[op])
    flat, gradient = f"(s_flat + {price(1)})", f"(s_gradient + {price(2)})"
    left, up, near, plane = f"(s_left + {price(6)})", f"(s_up + {price(6)})", f"(s_causal + {PRICE})", f"(s_plane + {PRICE})"
    axis, edge, block = f"least({left}, {up})", f"least({near}, {plane})", f"least({flat}, {gradient})"
    return {
        "q0": pair(f"least({axis}, {edge})", block), "q1": pair(up, left), "q2": pair(flat, gradient), "q3": pair(axis, edge), "q4": pair(near, plane),
        "single": f"least({flat}, {gradient}, {left}, {up}, {near}, {plane})",
    }


def operation() -> tuple[str, str]:
    """Operation and score of a block; ties to the lowest number. A mixture must win by a sixty-fourth over every single prediction."""
    scores = [f"(s_{n} + {PRICE * (1 + PARAMETERS[i])})" for i, n in enumerate(("zero", "flat", "gradient", "left", "up", "causal"))]
    mixed = "(CASE WHEN s_mixture + s_mixture // 64 < single THEN s_mixture END)"
    every = ", ".join(f"coalesce({s}, 1000000000)" for s in (*scores, mixed))
    least = f"least({every})"
    return "CASE " + " ".join(f"WHEN {s} = {least} THEN {i}" for i, s in enumerate((*scores, mixed))) + " END", least


def _cells(rows: DataFrame) -> DataFrame:
    """The stencil with ty, tx, `beside` and `above`; lines meet the line a block above by key."""
    up = rows.select("img", (F.col("y") + SIZE).alias("y"), F.col("line").alias("line_above"))
    cells = stencil(rows.withColumn("own", F.col("line")).join(up, ["img", "y"], "left"), 128, "own", "line_above")
    at = lambda line, i: F.expr(f"get({line}, {i})")
    return cells.select("img", "y", "x", "v", "W", "N", "NW", F.expr(f"y div {SIZE}").alias("ty"), F.expr(f"x div {SIZE}").alias("tx"), at("own", f"x - {SIZE}").alias("beside"), at("line_above", "x").alias("above"))


def predictions(rows: DataFrame) -> DataFrame:
    """A row for each sample: img, ty, tx, v and p_zero to p_plane."""
    cells = _cells(rows)
    place = lambda s, t: F.struct((s * F.col("y")).alias("a"), (t * F.col("x")).alias("b"))
    n = F.count("*").alias("n")
    blocks = cells.groupBy("img", "ty", "tx").agg(
        n, F.sum("v").alias("total"), F.sum(F.expr(f.spark(step("beside")))).alias("left_total"), F.sum(F.expr(f.spark(step("above")))).alias("up_total"),
        (F.max("x") - F.min("x") + 1).alias("bw"), (F.max("y") - F.min("y") + 1).alias("bh"),
        *(F.max_by("v", place(s, t)).alias(c) for c, s, t in (("c0", -1, -1), ("c1", -1, 1), ("c2", 1, -1), ("c3", 1, 1))),
    )
    blocks = blocks.select("img", "ty", "tx", "bw", "bh", "c0", "c1", "c2", "c3", F.expr("(total + n div 2) div n").alias("flat"), F.expr(f.spark(mean_step("left_total", "n"))).alias("dleft"), F.expr(f.spark(mean_step("up_total", "n"))).alias("dup"))
    joined = cells.join(blocks, ["img", "ty", "tx"])
    return joined.select("img", "ty", "tx", "v", *(F.when(F.col(need).isNotNull(), F.expr(f.spark(t))).cast("int").alias(f"p_{name}") for name, t in SINGLE.items() for need in [{"left": "beside", "up": "above"}.get(name, "v")]))


def weights(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks with s_zero to s_plane (sums of residual classes), q0 to q4 and `single`; and the mixtures tried: img, ty, tx, trial, score."""
    cells = predictions(rows)
    sums = cells.groupBy("img", "ty", "tx").agg(*(F.sum(F.expr(size_class(f"v - p_{n}"))).alias(f"s_{n}") if n not in ("left", "up") else F.sum(F.when(F.col(f"p_{n}").isNotNull(), F.expr(size_class(f"v - p_{n}")))).alias(f"s_{n}") for n in SINGLE))
    blocks = sums.select("*", *(F.expr(f.spark(t)).cast("int").alias(n) for n, t in coordinates().items()))
    tried = cells.join(blocks.select("img", "ty", "tx", "q0", "q1", "q2", "q3", "q4"), ["img", "ty", "tx"])
    each = F.array(*(F.sum(F.expr(f.spark(size_class(f"v - {mixture(t)}")))) for t in TRIALS))
    scores = tried.groupBy("img", "ty", "tx").agg(each.alias("scores")).select("img", "ty", "tx", F.posexplode("scores").alias("trial", "score"))
    return blocks, scores.withColumn("score", F.col("score") + PRICE * (1 + PARAMETERS[6]))


def pdm_weights(rows: DataFrame) -> DataFrame:
    """img, ty, tx, q0 to q4, score and used: each block's best mixture, ties to the first tried, and whether it beats every single
    prediction by a sixty-fourth."""
    blocks, scores = weights(rows)
    best = scores.groupBy("img", "ty", "tx").agg(F.min(F.struct("score", "trial")).alias("m"))
    found = best.join(blocks, ["img", "ty", "tx"]).withColumns({"trial": F.col("m.trial"), "score": F.col("m.score")})
    q = [F.expr("CASE trial " + " ".join(f"WHEN {i} THEN {t[k]}" for i, t in enumerate(TRIALS)) + " END").cast("int").alias(f"q{k}") for k in range(5)]
    return found.select("img", "ty", "tx", *q, "score", F.expr("score + score div 64 < single").alias("used"))


def block_scores(rows: DataFrame) -> DataFrame:
    """img, ty, tx, op and score over all seven operations."""
    blocks, scores = weights(rows)
    found = blocks.join(scores.groupBy("img", "ty", "tx").agg(F.min("score").alias("s_mixture")), ["img", "ty", "tx"])
    op, least = operation()
    return found.select("img", "ty", "tx", F.expr(f.spark(op)).cast("int").alias("op"), F.expr(f.spark(least)).cast("long").alias("score"))
