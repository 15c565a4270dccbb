"""Queries over prediction and colour, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import formulas as f
from tessera.operators import colour, neighbors, predict
from tessera.sources import raster


def _m(text: str, m: int = 255) -> str:
    return f.named(text, M=m)


def _stencil(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    return neighbors.stencil(raster.gray(spark, sf_dir, shift))


def _colours(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    return raster.colours(raster.rgba(spark, sf_dir, shift), "img", "y")


def med_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stencil(spark, sf_dir).groupBy(predict.residual(f.MED).alias("residual")).agg(F.count("*").alias("n"))


MED_HIST = raster.stencil_sql() + f"\nSELECT {_m(f.residual('v', f.MED))} AS residual, count(*) AS n FROM st GROUP BY 1"


def _errors(family: list[str]):
    return lambda spark, sf_dir: predict.total_errors(_stencil(spark, sf_dir), family)


def _errors_sql(family: list[str]) -> str:
    one = [f"SELECT {i} AS id, CAST(sum(abs({_m(f.residual('v', p))})) AS BIGINT) AS abs_sum FROM st" for i, p in enumerate(family)]
    return raster.stencil_sql() + "\n" + "\nUNION ALL ".join(one)


def _tiles(log: int):
    return lambda spark, sf_dir: predict.cheapest(predict.tile_costs(_stencil(spark, sf_dir), f.PREDICT_A, log))


def tile_pyramid32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 32 from the sums of tiles of 8."""
    return predict.cheapest(predict.coarser(predict.tile_costs(_stencil(spark, sf_dir), f.PREDICT_A, 3), 2))


def _tiles_sql(log: int) -> str:
    one = [f"SELECT img, y >> {log} AS ty, x >> {log} AS tx, {i} AS id, CAST(sum({_m(f.cost('abs(' + f.residual('v', p) + ')'))}) AS BIGINT) AS cost FROM st GROUP BY ALL" for i, p in enumerate(f.PREDICT_A)]
    return raster.stencil_sql() + ",\ncosts AS (" + "\nUNION ALL ".join(one) + ")\nSELECT img, ty, tx, id, cost FROM costs QUALIFY row_number() OVER (PARTITION BY img, ty, tx ORDER BY cost, id) = 1"


def filter_rows_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.line_filters(raster.gray(spark, sf_dir))


def _filters_sql() -> str:
    score = lambda t: f"CAST(sum(least((v - ({t})) & 255, 256 - ((v - ({t})) & 255))) AS BIGINT)"
    one = [f"SELECT img, y, {c} AS filter, {i} AS place, {score(predict.BYTE_FILTERS[c])} AS score FROM b GROUP BY img, y" for i, c in enumerate((1, 2, 5))]
    return (
        raster.stencil_sql()
        + ",\nb AS (SELECT img, y, v, coalesce(lw, 0) AS L, coalesce(ln, 0) AS U, coalesce(lnw, 0) AS UL FROM st),\ns AS ("
        + "\nUNION ALL ".join(one)
        + ")\nSELECT img, y, filter, score FROM s QUALIFY row_number() OVER (PARTITION BY img, y ORDER BY score, place) = 1"
    )


_HINT = f"sign(({f.GAP}) - ({f.MED}))"


def gap_rule_signhint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the sign of GAP against MED: pixels and residual sizes of GAP and of the rule."""
    hint = F.expr(_m(_HINT)).cast("int").alias("hint")
    size = lambda p: F.sum(F.abs(predict.residual(p)))
    return _stencil(spark, sf_dir).groupBy(hint).agg(F.count("*").alias("n"), size(f.GAP).alias("gap_abs"), size(f.RULE).alias("rule_abs"))


def _hint_sql() -> str:
    size = lambda p: f"CAST(sum(abs({_m(f.residual('v', p))})) AS BIGINT)"
    return raster.stencil_sql() + f"\nSELECT CAST({_m(_HINT)} AS INT) AS hint, count(*) AS n, {size(f.GAP)} AS gap_abs, {size(f.RULE)} AS rule_abs FROM st GROUP BY 1"


def color_fwd_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return colour.plane_sums(_colours(spark, sf_dir))


def color_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return colour.round_trips(_colours(spark, sf_dir))


def _fwd_sql() -> str:
    one = [f"SELECT {t} AS t, " + ", ".join(f"CAST(sum({e}) AS BIGINT) AS s{i}" for i, e in enumerate(f.transform(t))) + " FROM rgba" for t in range(36)]
    return raster.rgba_sql() + "\n" + "\nUNION ALL ".join(one)


def _roundtrip_sql() -> str:
    one = []
    for t in range(36):
        p, q, s = f.transform(t)
        r, g, b = f.inverse(t)
        one.append(f"SELECT {t} AS t, count(*) FILTER (WHERE {r} <> r0 OR {g} <> g0 OR {b} <> b0) AS mismatches FROM (SELECT r AS r0, g AS g0, b AS b0, {p} AS p, {q} AS q, {s} AS s FROM rgba)")
    return raster.rgba_sql() + "\n" + "\nUNION ALL ".join(one)


def transform_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raster.rgba(spark, sf_dir)
    return colour.ranked_transforms(rows, 16, rows.count())


def _rank_sql() -> str:
    one = []
    for t in range(36):
        for i, e in enumerate(f.transform(t)):
            m = 255 if i == 0 or t == 0 else 511
            half = (m + 1) // 2
            lags = f"""lags AS (SELECT img, y, x, v, lag(v) OVER r AS lw, lag(v) OVER c AS ln FROM p WINDOW r AS (PARTITION BY img, y ORDER BY x), c AS (PARTITION BY img, x ORDER BY y)),
            more AS (SELECT *, lag(ln) OVER r AS lnw, lead(ln) OVER r AS lne FROM lags WINDOW r AS (PARTITION BY img, y ORDER BY x)),
            st AS (SELECT y, x, v, coalesce(lw, ln, {half}) AS W, coalesce(ln, lw, {half}) AS N, coalesce(lnw, ln, lw, {half}) AS NW, coalesce(lne, ln, lw, {half}) AS NE FROM more)"""
            one.append(f"SELECT {t} AS t, {colour.RANKING.index(t)} AS r, * FROM (WITH p AS (SELECT img, y, x, {e} AS v FROM rgba), {lags} SELECT sum({_m(f.cost('abs(' + f.residual('v', f.MED) + ')'), m)}) AS cost FROM st WHERE y % (SELECT (count(*) + 127) // 128 FROM embeddings) = 0)")
    return raster.rgba_sql() + ",\ncosts AS (" + "\nUNION ALL ".join(one) + ")\nSELECT t, CAST(sum(cost) AS BIGINT) AS cost, CAST(row_number() OVER (ORDER BY sum(cost), r) AS INT) AS place FROM costs GROUP BY t, r"


def sample_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return colour.mode_sums(_colours(spark, sf_dir))


def _modes_sql() -> str:
    one = [f"SELECT '{m}' AS mode, " + ", ".join(f"CAST(sum({e}) AS BIGINT) AS s{i}" for i, e in enumerate(es)) + " FROM rgba" for m, es in colour.MODES.items()]
    return raster.rgba_sql() + "\n" + "\nUNION ALL ".join(one)


def _on_four_bits(c: str) -> str:
    return f"((({c}) * 255 + 7) // 15)"


def image_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of the image and of its four-bit version, gray and opaque."""
    as_is = _colours(spark, sf_dir).select("img", *"rgba")
    coarse = _colours(spark, sf_dir, 4).select(F.lit(1).alias("img"), *(F.expr(f.spark(_on_four_bits("r"))).cast("int").alias(c) for c in "rgb"), F.lit(255).alias("a"))
    return colour.image_flags(as_is.unionByName(coarse))


def _flags_sql() -> str:
    ok = [f"bool_and({' AND '.join(colour.on_grid(c, d) for c in 'rgb')})" for d in range(1, 8)]
    depth = "CASE " + " ".join(f"WHEN {e} THEN {d}" for d, e in enumerate(ok, 1)) + " ELSE 8 END"
    return (
        raster.rgba_sql()
        + f",\ntwo AS (SELECT img, r, g, b, a FROM rgba UNION ALL SELECT 1 AS img, {_on_four_bits('r >> 4')}, {_on_four_bits('r >> 4')}, {_on_four_bits('r >> 4')}, 255 FROM rgba)"
        + f"\nSELECT img, count(*) AS pixels, min(a) = 255 AS opaque, bool_and(r = g AND g = b) AS is_gray, min(a) = max(a) AS constant_alpha, {depth} AS depth FROM two GROUP BY img"
    )


def noise_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an image looks noisy: mean difference of pixels `step` apart in line order above 78."""
    rows = raster.gray(spark, sf_dir)
    return predict.noise(rows)


NOISE = (
    raster.gray_sql()
    + """,
n AS (SELECT img, v, row_number() OVER (PARTITION BY img ORDER BY y, x) - 1 AS i, count(*) OVER (PARTITION BY img) AS pixels FROM gray),
s AS (SELECT img, pixels, abs(v - lag(v) OVER (PARTITION BY img ORDER BY i)) AS d FROM n WHERE i % (pixels // 262144 + 1) = 0)
SELECT img, max(pixels) AS pixels, CAST(sum(d) AS BIGINT) AS total, count(d) AS pairs, max(pixels) >= 4096 AND sum(d) // count(d) > 78 AS noisy FROM s GROUP BY img"""
)


def zero_run_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether at least a quarter of MED residuals on the sampled grid are 0, for the image in 1 to 4 bits."""
    every = [neighbors.stencil(raster.gray(spark, sf_dir, s)).withColumn("bits", F.lit(8 - s)) for s in (7, 6, 5, 4)]
    height = raster.gray(spark, sf_dir).count()
    grid = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3]).filter(F.col("y") % (-(-height // 128)) == 0)
    zero = F.count_if(predict.residual(f.MED) == 0)
    return grid.groupBy("bits").agg(zero.alias("zeros"), F.count("*").alias("total"), (zero * 4 >= F.count("*")).alias("worth"))


def _zero_sql() -> str:
    one = [f"SELECT {8 - s} AS bits, * FROM ({raster.stencil_sql(s)}\nSELECT count(*) FILTER (WHERE {_m(f.residual('v', f.MED))} = 0) AS zeros, count(*) AS total FROM st WHERE y % (SELECT (count(*) + 127) // 128 FROM embeddings) = 0)" for s in (7, 6, 5, 4)]
    return "SELECT *, zeros * 4 >= total AS worth FROM (" + "\nUNION ALL ".join(one) + ")"


QUERIES = {
    "med_hist": med_hist, "predict_x_all": _errors(f.PREDICT_X), "predict_a_all": _errors(f.PREDICT_A), "tile_argmin16": _tiles(4), "tile_argmin8": _tiles(3),
    "tile_pyramid32": tile_pyramid32, "filter_rows_best": filter_rows_best, "gap_rule_signhint": gap_rule_signhint, "color_fwd_all": color_fwd_all,
    "color_roundtrip": color_roundtrip, "transform_rank": transform_rank, "sample_modes": sample_modes, "image_flags": image_flags, "noise_probe": noise_probe,
    "zero_run_probe": zero_run_probe,
}
ORACLES = {
    "med_hist": MED_HIST, "predict_x_all": _errors_sql(f.PREDICT_X), "predict_a_all": _errors_sql(f.PREDICT_A), "tile_argmin16": _tiles_sql(4), "tile_argmin8": _tiles_sql(3),
    "tile_pyramid32": _tiles_sql(5), "filter_rows_best": _filters_sql(), "gap_rule_signhint": _hint_sql(), "color_fwd_all": _fwd_sql(),
    "color_roundtrip": _roundtrip_sql(), "transform_rank": _rank_sql(), "sample_modes": _modes_sql(), "image_flags": _flags_sql(), "noise_probe": NOISE,
    "zero_run_probe": _zero_sql(),
}
