"""Queries over block models, probes and gates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import formulas as f
from tessera.operators import block_models, neighbors, predict, probes, structure
from tessera.plans.structure_queries import _BLOCKS_SQL, _MOSAIC_SQL, _mosaic
from tessera.sources import raster


#: An image with flat, sloping, repeated and noisy parts.
_SMOOTH = (
    "(CASE WHEN x < 16 THEN (v0 >> 5) + 100 WHEN x < 32 THEN (v0 >> 6) + 3 * x + 2 * (y % 16) WHEN x < 40 THEN ((y % 16) * (y % 16) * 7 + x * x * 5) & 255 WHEN x < 48 THEN (v0 >> 5) + 8 * (y % 16) + y % 3"
    " WHEN y % 64 < 32 THEN (v0 >> 4) + 5 * (x - 48) + 90 ELSE v0 END)"
)


def _smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.gray(spark, sf_dir).select("img", "y", F.expr(f"transform(line, (v0, x) -> CAST({_SMOOTH} AS INT))").alias("line"))


_SMOOTH_SQL = f"WITH {raster.PX},\ngray AS (SELECT 0 AS img, y, x, CAST({_SMOOTH} AS INT) AS v FROM px),\n{raster.STENCIL.format(half=128)}"


def block_scores_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest of all seven operations for each block."""
    return block_models.block_scores(_smooth(spark, sf_dir))


def pdm_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates and score of each block's best mixture."""
    return block_models.pdm_weights(_smooth(spark, sf_dir))


def _models_sql() -> str:
    size, classes = block_models.SIZE, structure.size_class
    singles = ", ".join(f"CAST(CASE WHEN {dict(left='beside', up='above').get(n, 'v')} IS NOT NULL THEN {t} END AS INT) AS p_{n}" for n, t in block_models.SINGLE.items())
    sums = ", ".join(f"CAST(sum(CASE WHEN p_{n} IS NOT NULL THEN {classes(f'v - p_{n}')} END) AS BIGINT) AS s_{n}" for n in block_models.SINGLE)
    coordinates = ", ".join(f"{t} AS {n}" for n, t in block_models.coordinates().items())
    price = block_models.PRICE * (1 + block_models.PARAMETERS[6])
    trials = "\n    UNION ALL ".join(f"SELECT img, ty, tx, {i} AS trial, CAST(sum({classes(f'v - {block_models.mixture(t)}')}) + {price} AS BIGINT) AS score FROM tried GROUP BY ALL" for i, t in enumerate(block_models.TRIALS))
    return (
        _SMOOTH_SQL
        + f""",
ce AS (SELECT *, y // {size} AS ty, x // {size} AS tx, lag(v, {size}) OVER (PARTITION BY img, y ORDER BY x) AS beside, lag(v, {size}) OVER (PARTITION BY img, x ORDER BY y) AS above FROM st),
pb AS (SELECT img, ty, tx, count(*) AS n, sum(v) AS total, sum({block_models.step('beside')}) AS left_total, sum({block_models.step('above')}) AS up_total, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh,
    arg_min(v, y * 4096 + x) AS c0, arg_min(v, y * 4096 - x) AS c1, arg_max(v, y * 4096 - x) AS c2, arg_max(v, y * 4096 + x) AS c3 FROM ce GROUP BY ALL),
pq AS (SELECT img, ty, tx, bw, bh, c0, c1, c2, c3, (total + n // 2) // n AS flat, {block_models.mean_step('left_total', 'n')} AS dleft, {block_models.mean_step('up_total', 'n')} AS dup FROM pb),
pr AS (SELECT ce.img, ce.ty, ce.tx, v, {singles} FROM ce JOIN pq ON pq.img = ce.img AND pq.ty = ce.ty AND pq.tx = ce.tx),
su AS (SELECT img, ty, tx, {sums} FROM pr GROUP BY ALL),
co AS (SELECT *, {coordinates} FROM su),
tried AS (SELECT pr.*, q0, q1, q2, q3, q4 FROM pr JOIN co ON co.img = pr.img AND co.ty = pr.ty AND co.tx = pr.tx),
tr AS ({trials}),
be AS (SELECT img, ty, tx, arg_min(trial, score * 100 + trial) AS trial, min(score) AS s_mixture FROM tr GROUP BY ALL)"""
    )


_OP, _LEAST = block_models.operation()
BLOCK_SCORES_ALL = _models_sql() + f"\nSELECT co.img, co.ty, co.tx, CAST({_OP} AS INT) AS op, CAST({_LEAST} AS BIGINT) AS score FROM co JOIN be ON be.img = co.img AND be.ty = co.ty AND be.tx = co.tx"
PDM_WEIGHTS = (
    _models_sql()
    + "\nSELECT co.img, co.ty, co.tx, "
    + ", ".join("CAST(CASE trial " + " ".join(f"WHEN {i} THEN {t[k]}" for i, t in enumerate(block_models.TRIALS)) + f" END AS INT) AS q{k}" for k in range(5))
    + ", s_mixture AS score, s_mixture + s_mixture // 64 < single AS used FROM co JOIN be ON be.img = co.img AND be.ty = co.ty AND be.tx = co.tx"
)


def gray_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct samples of the raster at four depths."""
    every = raster.embeddings(spark, sf_dir).select(F.explode(F.array(*(F.lit(s) for s in (0, 2, 4, 6)))).alias("img"), "line")
    return probes.gray_kinds(every.select("img", F.expr("transform(line, v -> shiftright(v, img))").alias("line")), 64)


GRAY_DISTINCT = "WITH " + raster.PX + "\nSELECT s AS img, count(DISTINCT v0 >> s) AS kinds, count(DISTINCT v0 >> s) <= 64 AS few FROM px, (SELECT unnest([0, 2, 4, 6]) AS s) GROUP BY s"


def palette_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct colours of the raster at three depths, and whether they fit a palette."""
    at = lambda s: raster.colours(raster.rgba(spark, sf_dir, s), "y").withColumn("img", F.lit(s))
    return probes.colour_kinds(at(4).unionByName(at(6)).unionByName(at(7)))


PALETTE_PROBE = "\nUNION ALL ".join(f"SELECT {s} AS img, count(*) AS kinds, count(*) <= 256 AS few FROM ({raster.rgba_sql(s)} SELECT DISTINCT r, g, b, a FROM rgba)" for s in (4, 6, 7))


def block_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Useful blocks of the raster and of the mosaic."""
    gray = structure.blocks(raster.gray(spark, sf_dir))
    mosaic = structure.blocks(_mosaic(spark, sf_dir)).withColumn("img", F.lit(1))
    return probes.block_probe(gray.unionByName(mosaic), 4)


def _block_probe_sql() -> str:
    def one(start: str, img: int) -> str:
        return (
            start
            + _BLOCKS_SQL
            + f""",
hb AS (SELECT *, greatest((max(ty) OVER () + 1) // {probes.SIDE}, 1) AS ys FROM bl),
sm AS (SELECT * FROM hb WHERE ty % ys = 0 AND ty // ys * 4 + tx < {probes.MOST}),
us AS (SELECT s.*, row_number() OVER (PARTITION BY s.cells, s.bw, s.bh ORDER BY s.ty, s.tx) > 1 OR s.colours <= 4 OR coalesce(l.cells = s.cells AND l.bw = s.bw, false) OR coalesce(u.cells = s.cells AND u.bh = s.bh, false) AS fine
    FROM sm s LEFT JOIN bl l ON l.ty = s.ty AND l.tx = s.tx - 1 LEFT JOIN bl u ON u.ty = s.ty - 1 AND u.tx = s.tx)
SELECT {img} AS img, count(*) AS sampled, count(*) FILTER (WHERE fine) AS useful, (count(*) >= {probes.LEAST} OR count(*) = {probes.MOST}) AND count(*) FILTER (WHERE fine) * {probes.PART} >= count(*) AS worth FROM us"""
        )

    return f"SELECT * FROM ({one(raster.gray_sql(), 0)}) UNION ALL SELECT * FROM ({one(_MOSAIC_SQL, 1)})"


def map_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 8 by 8 whose predictor must be told."""
    costs = predict.tile_costs(neighbors.stencil(raster.gray(spark, sf_dir)), f.PREDICT_X[:8], 3)
    return probes.explicit_ids(predict.cheapest(costs))


def _map_gate_sql() -> str:
    costs = ", ".join(f"sum({f.named(f.cost('abs(' + f.residual('v', p) + ')'), M=255)}) AS c{i}" for i, p in enumerate(f.PREDICT_X[:8]))
    least = "least(" + ", ".join(f"c{i}" for i in range(8)) + ")"
    return (
        raster.stencil_sql()
        + f""",
tc AS (SELECT img, y >> 3 AS ty, x >> 3 AS tx, {costs} FROM st GROUP BY ALL),
ti AS (SELECT img, ty, tx, CASE {' '.join(f'WHEN c{i} = {least} THEN {i}' for i in range(8))} END AS id FROM tc),
nb AS (SELECT *, lag(id) OVER (PARTITION BY img, ty ORDER BY tx) AS l, lag(id) OVER (PARTITION BY img, tx ORDER BY ty) AS u FROM ti),
ex AS (SELECT img, NOT (coalesce(id = l, false) OR coalesce(id = u AND (l IS NULL OR u <> l), false)) AS told FROM nb)
SELECT img, count(*) AS tiles, count(*) FILTER (WHERE told) AS explicit, count(*) FILTER (WHERE told) * 100 >= count(*) * 25 AS worth FROM ex GROUP BY img"""
    )


def phase_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A periodic model of the mosaic with every sixth line changed: samples it gives, and whether they are enough."""
    rows = raster.gray(spark, sf_dir, 6)
    pixels = raster.pixels(rows.withColumn("line", F.expr("transform(line, (v, x) -> IF(y % 16 = 0, v, (x % 4) * 3 + y % 4))")), "img", "y")
    return probes.phase_matches(structure.phases(pixels, 4, 0, 0), pixels.groupBy("img").agg(F.count("*").alias("pixels")))


PHASE_GATE = (
    raster.gray_sql(6)
    + """,
m AS (SELECT img, y, x, CASE WHEN y % 16 = 0 THEN v ELSE (x % 4) * 3 + y % 4 END AS v FROM gray),
c AS (SELECT img, y % 4 AS py, x % 4 AS px, v, count(*) AS n FROM m GROUP BY ALL),
b AS (SELECT img, py, px, max(n) AS n FROM c GROUP BY ALL)
SELECT img, CAST(sum(n) AS BIGINT) AS matches, (SELECT count(*) FROM m) AS pixels, sum(n) * 10 >= (SELECT count(*) FROM m) * 9 AND (SELECT count(*) FROM m) <= 2097152 AS worth FROM b GROUP BY img"""
)


def block_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.block_bases(structure.blocks(_mosaic(spark, sf_dir)))


BLOCK_BASES = (
    _MOSAIC_SQL
    + ",\nc AS (SELECT img, y // 16 AS ty, x // 16 AS tx, v, count(*) AS n FROM gray GROUP BY ALL)\nSELECT img, ty, tx, v AS base, CAST(n AS INT) AS n FROM c QUALIFY row_number() OVER (PARTITION BY img, ty, tx ORDER BY n DESC, v) = 1"
)


def block_op_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks each operation takes, and mean coordinates of the mixtures that are used (whole, rounded down; -1 for other operations)."""
    gray = _smooth(spark, sf_dir)
    ops = block_models.block_scores(gray).groupBy("img", "op").agg(F.count("*").alias("blocks"))
    used = block_models.pdm_weights(gray).filter("used").groupBy("img").agg(*(F.expr(f"sum(q{k}) div count(*)").alias(f"q{k}") for k in range(5)))
    means = used.withColumn("op", F.lit(6))
    return ops.join(means, ["img", "op"], "left").fillna(-1)


BLOCK_OP_COUNTS = (
    f"WITH o AS (SELECT img, op, count(*) AS blocks FROM ({BLOCK_SCORES_ALL}) GROUP BY ALL),\nw AS (SELECT img, 6 AS op, "
    + ", ".join(f"CAST(sum(q{k}) // count(*) AS BIGINT) AS q{k}" for k in range(5))
    + f" FROM ({PDM_WEIGHTS}) WHERE used GROUP BY img)\nSELECT o.img, o.op, blocks, " + ", ".join(f"coalesce(q{k}, -1) AS q{k}" for k in range(5)) + " FROM o LEFT JOIN w ON w.img = o.img AND w.op = o.op"
)


def slow_coder_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a slow coder is worth a run, over made sizes, by quantity."""
    sizes = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("CAST(l_quantity AS BIGINT) AS quantity", "l_orderkey % 4096 AS payload", "l_partkey % 1024 AS proxy", "l_partkey % 4096 AS total", "l_suppkey * 37 % 4096 AS incumbent")
    worth = F.expr(f.spark(probes.WORTH_A_RUN))
    return sizes.groupBy("quantity").agg(F.count("*").alias("files"), F.count_if(worth).alias("worth"))


SLOW_CODER_GATE = f"""SELECT quantity, count(*) AS files, count(*) FILTER (WHERE {probes.WORTH_A_RUN}) AS worth
FROM (SELECT CAST(l_quantity AS BIGINT) AS quantity, l_orderkey % 4096 AS payload, l_partkey % 1024 AS proxy, l_partkey % 4096 AS total, l_suppkey * 37 % 4096 AS incumbent FROM lineitem) GROUP BY quantity"""


def region_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line sums of a rectangle cut out of the raster."""
    cut = probes.region(raster.gray(spark, sf_dir), 5, 7, 20, 1 << 40)
    return cut.select("img", "y", F.size("line").alias("w"), F.expr("aggregate(line, 0L, (a, v) -> a + v)").alias("total"))


REGION_SUMS = raster.gray_sql() + "\nSELECT img, y - 7 AS y, CAST(count(*) AS INT) AS w, CAST(sum(v) AS BIGINT) AS total FROM gray WHERE y >= 7 AND x >= 5 AND x < 25 GROUP BY img, y"

QUERIES = {
    "block_scores_all": block_scores_all, "pdm_weights": pdm_weights, "gray_distinct": gray_distinct, "palette_probe": palette_probe, "block_probe": block_probe, "map_gate": map_gate,
    "phase_gate": phase_gate, "block_bases": block_bases, "block_op_counts": block_op_counts, "slow_coder_gate": slow_coder_gate, "region_sums": region_sums,
}
ORACLES = {
    "block_scores_all": BLOCK_SCORES_ALL, "pdm_weights": PDM_WEIGHTS, "gray_distinct": GRAY_DISTINCT, "palette_probe": PALETTE_PROBE, "block_probe": _block_probe_sql(), "map_gate": _map_gate_sql(),
    "phase_gate": PHASE_GATE, "block_bases": BLOCK_BASES, "block_op_counts": BLOCK_OP_COUNTS, "slow_coder_gate": SLOW_CODER_GATE, "region_sums": REGION_SUMS,
}
