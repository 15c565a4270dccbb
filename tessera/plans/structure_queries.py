"""Queries over dictionaries, runs, models, blocks and frames, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import formulas as f
from tessera.operators import frames, neighbors, predict, structure
from tessera.sources import raster


def _colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.colours(raster.rgba(spark, sf_dir, 6), "img", "y")


def palette_lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.palette(_colours(spark, sf_dir)).select("img", "idx", "r", "g", "b", "a", "n")


def palette_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.palette_by_luma(_colours(spark, sf_dir)).select("img", "idx", "r", "g", "b", "a", "n")


def index_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    colours = _colours(spark, sf_dir)
    found = structure.indexed(colours, structure.palette(colours))
    return found.groupBy("img", "idx").agg(F.count("*").alias("n"), F.sum(F.expr("y * 16 + x")).alias("places"))


_KINDS = raster.rgba_sql(6) + ",\nk AS (SELECT img, r, g, b, a, count(*) AS n, min(y * 16 + x) AS first FROM rgba GROUP BY img, r, g, b, a)"
PALETTE_LEX = _KINDS + "\nSELECT img, CAST(row_number() OVER (PARTITION BY img ORDER BY r, g, b, a) - 1 AS INT) AS idx, r, g, b, a, n FROM k"
PALETTE_LUMA = (
    _KINDS
    + "\nSELECT img, CAST(row_number() OVER (PARTITION BY img ORDER BY 2 * r + 5 * g + b, first) - 1 AS INT) AS idx, r, g, b, a, n FROM (SELECT *, count(*) OVER (PARTITION BY img) AS size FROM k) WHERE size <= 256"
)
INDEX_HISTOGRAM = (
    raster.rgba_sql(6)
    + "\nSELECT img, CAST(idx AS INT) AS idx, count(*) AS n, CAST(sum(y * 16 + x) AS BIGINT) AS places FROM (SELECT img, y, x, dense_rank() OVER (PARTITION BY img ORDER BY r, g, b, a) - 1 AS idx FROM rgba) GROUP BY img, idx"
)


def rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.runs(raster.gray(spark, sf_dir, 6))


RLE_RUNS = (
    raster.gray_sql(6)
    + """,
c AS (SELECT *, CASE WHEN lag(v) OVER (ORDER BY y, x) = v THEN 0 ELSE 1 END AS new FROM gray),
g AS (SELECT *, sum(new) OVER (ORDER BY y, x) AS run FROM c)
SELECT img, min(y) AS y, CAST(min(y * 64 + x) % 64 AS INT) AS x, min(v) AS v, count(*) AS n FROM g GROUP BY img, run"""
)


def _indexed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    colours = _colours(spark, sf_dir)
    found = structure.indexed(colours, structure.palette(colours)).withColumnRenamed("idx", "v")
    return raster.unexploded(found, "img", "y")


def index_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of runs of palette places in line order."""
    return structure.runs(_indexed_rows(spark, sf_dir)).groupBy("img", "n").agg(F.count("*").alias("runs"))


INDEX_RUNS = (
    raster.rgba_sql(6)
    + """,
i AS (SELECT img, y, x, dense_rank() OVER (PARTITION BY img ORDER BY r, g, b, a) AS v FROM rgba),
c AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY img ORDER BY y, x) = v THEN 0 ELSE 1 END AS new FROM i),
g AS (SELECT *, sum(new) OVER (PARTITION BY img ORDER BY y, x) AS run FROM c)
SELECT img, n, count(*) AS runs FROM (SELECT img, run, count(*) AS n FROM g GROUP BY img, run) GROUP BY img, n"""
)


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.stencil(raster.gray(spark, sf_dir, 6)).select("img", "y", "x", predict.residual(f.MED).alias("e"))


_RESIDUALS = raster.stencil_sql(6) + f",\nres AS (SELECT img, y, x, {f.named(f.residual('v', f.MED), M=255)} AS e, (SELECT count(*) FROM embeddings) AS h FROM st)"


def event_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = raster.gray(spark, sf_dir).count()
    return structure.events(_residuals(spark, sf_dir), structure.ORDERS[0], 64, h)


EVENT_RANKS = _RESIDUALS + "\nSELECT img, rank, rank - coalesce(lag(rank) OVER (PARTITION BY img ORDER BY rank) + 1, 0) AS skip, e FROM (SELECT img, y * 64 + x AS rank, e FROM res WHERE e <> 0)"


def scan_orders_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = raster.gray(spark, sf_dir).count()
    return structure.order_costs(_residuals(spark, sf_dir), 64, h)


def _orders_sql() -> str:
    one = [f"SELECT img, {i} AS scan, {f.named(r, w=64)} AS rank, e FROM res WHERE e <> 0" for i, r in enumerate(structure.ORDERS)]
    return (
        _RESIDUALS
        + ",\nall8 AS ("
        + "\nUNION ALL ".join(one)
        + ")"
        + f""",
s AS (SELECT *, rank - coalesce(lag(rank) OVER (PARTITION BY img, scan ORDER BY rank) + 1, 0) AS skip FROM all8),
t AS (SELECT img, scan, count(*) AS n, sum({structure.run_cost('skip')} + {structure.run_cost('(abs(e) - 1)')} + 1) AS c FROM s GROUP BY img, scan)
SELECT img, scan, n, CAST(c + 4 + {structure.run_cost('n')} AS BIGINT) AS cost, row_number() OVER (PARTITION BY img ORDER BY c + {structure.run_cost('n')}, scan) = 1 AS best FROM t"""
    )


#: Three images with all lines of the table: one that separates, the raster itself, and one that is periodic but for bright samples.
#: c is a line's first sample.
_MADE = ("13 * x + x * x + c", "v", "5 * x + 9 * y + 31 * ((x % 4) * (y % 4)) + CASE WHEN v > 250 THEN v ELSE 0 END")
_MADE_SQL = (
    raster.gray_sql()
    + ",\nfirsts AS (SELECT y, x, v, max(CASE WHEN x = 0 THEN v END) OVER (PARTITION BY y) AS c FROM gray),\nmade AS ("
    + " UNION ALL ".join(f"SELECT {i} AS img, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(({t}) & 255 AS INT) AS v FROM firsts" for i, t in enumerate(_MADE))
    + ")"
)


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, y, line of the made images."""
    lines = F.array(*(F.expr(f"transform(line, (v, x) -> CAST(({t.replace('+ c', '+ line[0]')}) & 255 AS INT))") for t in _MADE))
    return raster.gray(spark, sf_dir).select(F.col("y").cast("int").alias("y"), F.posexplode(lines).alias("img", "line")).select("img", "y", "line")


def _made_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.pixels(made(spark, sf_dir), "img", "y")


def separable_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.separable(_made_samples(spark, sf_dir))


SEPARABLE_TEST = (
    _MADE_SQL
    + """,
j AS (SELECT m.*, r.v AS rv, c.v AS cv, o.v AS ov FROM made m JOIN made r ON r.img = m.img AND r.y = 0 AND r.x = m.x JOIN made c ON c.img = m.img AND c.x = 0 AND c.y = m.y JOIN made o ON o.img = m.img AND o.x = 0 AND o.y = 0)
SELECT img, count(*) AS pixels, count(*) FILTER (WHERE (rv + cv - ov) & 255 <> v) AS mismatches, count(*) FILTER (WHERE (rv + cv - ov) & 255 <> v) = 0 AS separable FROM j GROUP BY img"""
)


def separable_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.separable_deltas(_made_samples(spark, sf_dir))


SEPARABLE_DELTA = (
    _MADE_SQL
    + """
SELECT img, 'row' AS side, x AS i, (v - coalesce(lag(v) OVER (PARTITION BY img ORDER BY x), 0)) & 255 AS delta FROM made WHERE y = 0
UNION ALL SELECT img, 'column' AS side, y AS i, (v - coalesce(lag(v) OVER (PARTITION BY img ORDER BY y), 0)) & 255 AS delta FROM made WHERE x = 0"""
)


def gray_model_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.slopes(made(spark, sf_dir), 4)


GRAY_MODEL_SLOPE = (
    _MADE_SQL
    + """,
d AS (SELECT img, (v - lag(v, 4) OVER (PARTITION BY img, y ORDER BY x)) & 255 AS d FROM made),
h AS (SELECT img, d, count(*) AS n FROM d WHERE d IS NOT NULL GROUP BY img, d),
c AS (SELECT img, a, sum(n * least((d - a * 4) & 255, 256 - ((d - a * 4) & 255))) AS cost FROM h, (SELECT CAST(unnest(range(256)) AS INT) AS a) GROUP BY img, a)
SELECT img, a AS slope, CAST(cost AS BIGINT) AS cost FROM c QUALIFY row_number() OVER (PARTITION BY img ORDER BY cost, a) = 1"""
)


def gray_model_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.phases(_made_samples(spark, sf_dir), 4, 5, 9)


GRAY_MODEL_PHASE = (
    _MADE_SQL
    + """,
r AS (SELECT img, y % 4 AS py, x % 4 AS px, (v - 5 * x - 9 * y) & 255 AS v, count(*) AS n FROM made GROUP BY ALL)
SELECT img, py, px, v, n FROM r QUALIFY row_number() OVER (PARTITION BY img, py, px ORDER BY n DESC, v) = 1"""
)


def pattern_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.patterns(raster.gray(spark, sf_dir, 6))


PATTERN_DICTIONARY = (
    raster.gray_sql(6)
    + """,
b AS (SELECT img, y // 2 AS ty, x // 2 AS tx, max(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN v END) AS v0, max(CASE WHEN y % 2 = 0 AND x % 2 = 1 THEN v END) AS v1,
    max(CASE WHEN y % 2 = 1 AND x % 2 = 0 THEN v END) AS v2, max(CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN v END) AS v3 FROM gray GROUP BY ALL),
k AS (SELECT img, v0, v1, v2, v3, count(*) AS n, min(ty * 1000 + tx) AS first FROM b GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY img) AS blocks, row_number() OVER (PARTITION BY img ORDER BY n DESC, first) AS token FROM k),
c AS (SELECT *, sum(n) OVER (PARTITION BY img) * 4 >= blocks AS ok FROM t WHERE n > 1 AND token <= 127)
SELECT img, CAST(token AS INT) AS token, v0, v1, v2, v3, n FROM c WHERE ok"""
)

#: An image with flat, repeated, two-colour and four-colour blocks.
_MOSAIC = "CASE WHEN x < 16 THEN 0 WHEN x < 32 THEN (y {div} 16) % 3 WHEN x < 48 THEN v0 >> 7 ELSE v0 >> 6 END"
_MOSAIC_SQL = "WITH " + raster.PX + ",\ngray AS (SELECT 0 AS img, y, x, CAST(" + _MOSAIC.format(div="//") + " AS INT) AS v FROM px)"


def _mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "transform(line, (v0, x) -> CAST(" + _MOSAIC.format(div="div") + " AS INT))"
    return raster.gray(spark, sf_dir).select("img", "y", F.expr(line).alias("line"))


_BLOCKS_SQL = """,
bl AS (SELECT img, y // 16 AS ty, x // 16 AS tx, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh, list(v ORDER BY y, x) AS cells, count(DISTINCT v) AS colours FROM gray GROUP BY ALL),
nb AS (SELECT *, ty * 4 + tx AS number FROM bl),
rf AS (SELECT *, number - lag(number) OVER (PARTITION BY img, cells, bw, bh ORDER BY number) AS distance FROM nb)"""


def block_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.earlier_blocks(structure.blocks(_mosaic(spark, sf_dir)), "4")
    return found.select("img", "ty", "tx", "distance")


BLOCK_REFS = _MOSAIC_SQL + _BLOCKS_SQL + "\nSELECT img, ty, tx, distance FROM rf"


def block_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.block_ops(structure.blocks(_mosaic(spark, sf_dir)), "4")


def _ops_sql() -> str:
    picks = ", ".join(f"{t} AS {n}" for n, t in structure.block_choice().items())
    return (
        _MOSAIC_SQL
        + _BLOCKS_SQL
        + f""",
pq AS (SELECT img, y // 16 AS ty, x // 16 AS tx, y // 2 AS py, x // 2 AS px, list(v ORDER BY y, x) AS p FROM gray GROUP BY ALL),
pc AS (SELECT img, ty, tx, count(DISTINCT CASE WHEN len(p) = 4 THEN p WHEN len(p) = 2 THEN p || p END) AS pats, count(*) AS subs FROM pq GROUP BY ALL),
al AS (SELECT rf.img, rf.ty, rf.tx, rf.bw * rf.bh AS area, rf.colours, pc.pats, pc.subs, rf.distance, coalesce(l.cells = rf.cells, false) AS "left", coalesce(u.cells = rf.cells AND u.bh = rf.bh, false) AS up
    FROM rf JOIN pc USING (img, ty, tx) LEFT JOIN bl l ON l.img = rf.img AND l.ty = rf.ty AND l.tx = rf.tx - 1 LEFT JOIN bl u ON u.img = rf.img AND u.ty = rf.ty - 1 AND u.tx = rf.tx)
SELECT img, ty, tx, {picks.replace('left THEN', '"left" THEN').replace('OR left', 'OR "left"')} FROM al"""
    )


def block_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.block_residual_scores(neighbors.stencil(raster.gray(spark, sf_dir)))


BLOCK_SCORES = (
    raster.stencil_sql()
    + f""",
m AS (SELECT img, y // 16 AS ty, x // 16 AS tx, (sum(v) + count(*) // 2) // count(*) AS mean FROM st GROUP BY ALL),
s AS (SELECT m.img, m.ty, m.tx, sum({structure.size_class('v')}) + 20 AS zero, sum({structure.size_class('v - CAST(mean AS INT)')}) + 40 AS flat, sum({structure.size_class('v - (' + structure.CAUSAL + ')')}) + 20 AS causal
    FROM st JOIN m ON m.img = st.img AND m.ty = y // 16 AND m.tx = x // 16 GROUP BY ALL)
SELECT img, ty, tx, CASE WHEN zero <= flat AND zero <= causal THEN 0 WHEN flat <= causal THEN 1 ELSE 5 END AS op, CAST(least(zero, flat, causal) AS BIGINT) AS score FROM s"""
)


def prefix_sum2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.prefix_sums(raster.gray(spark, sf_dir))


PREFIX_SUM2D = (
    raster.gray_sql()
    + """,
p AS (SELECT img, y, x, sum(v) OVER (PARTITION BY img, y ORDER BY x) AS p FROM gray)
SELECT img, y, CAST(x AS INT) AS x, CAST(sum(p) OVER (PARTITION BY img, x ORDER BY y) AS BIGINT) AS s FROM p"""
)


def _frames(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    """Frames in which half the lines hold still and every fifth frame repeats the one before."""
    rows = raster.frames(spark, sf_dir, 50, shift)
    line = "CASE WHEN y < 25 OR frame % 5 = 4 THEN transform(line, v -> 1) WHEN y >= 40 THEN transform(line, (v, x) -> (x + frame) % 7) ELSE line END"
    return rows.select("anim", F.expr("frame div 1").alias("frame"), "y", F.expr(line).alias("line"))


_FRAMES_SQL = (
    "WITH "
    + raster.PX
    + """,
fr AS (SELECT 0 AS anim, y // 50 AS frame, y % 50 AS y, x, CASE WHEN y % 50 < 25 OR (y // 50) % 5 = 4 THEN 1 WHEN y % 50 >= 40 THEN (x + y // 50) % 7 ELSE v0 >> {shift} END AS v FROM px),
d AS (SELECT a.anim, a.frame, a.y, a.x, a.v <> b.v AS c FROM fr a JOIN fr b ON b.anim = a.anim AND b.frame = a.frame - 1 AND b.y = a.y AND b.x = a.x),
r AS (SELECT anim, frame, min(x) FILTER (WHERE c) AS x0, min(y) FILTER (WHERE c) AS y0, max(x) FILTER (WHERE c) AS x1, max(y) FILTER (WHERE c) AS y1, count(*) FILTER (WHERE c) AS changed FROM d GROUP BY ALL)"""
)


def frame_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.deltas(_frames(spark, sf_dir, 7))


FRAME_DELTA = _FRAMES_SQL.format(shift=7) + "\nSELECT anim, frame, CAST(x0 AS INT) AS x0, y0, CAST(x1 - x0 + 1 AS INT) AS w, y1 - y0 + 1 AS h, changed FROM r"


def frame_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.kinds(_frames(spark, sf_dir, 7))


FRAME_TYPES = (
    _FRAMES_SQL.format(shift=7)
    + ",\nz AS (SELECT anim, frame, count(*) AS pixels FROM fr GROUP BY ALL)\nSELECT z.anim, z.frame, CASE WHEN changed IS NULL THEN 'key' WHEN changed = 0 THEN 'duplicate' WHEN 2 * (x1 - x0 + 1) * (y1 - y0 + 1) <= pixels THEN 'rectangle' ELSE 'key' END AS kind FROM z LEFT JOIN r ON r.anim = z.anim AND r.frame = z.frame"
)


def frame_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id AS anim", "event_id AS frame", "event_id * 7 % 50 AS delay")
    return frames.timeline(events)


FRAME_TIMELINE = """
SELECT anim, frame, delay, CAST(coalesce(sum(delay) OVER (PARTITION BY anim ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM (SELECT user_id AS anim, event_id AS frame, CASE WHEN event_id * 7 % 50 = 0 THEN 100 ELSE event_id * 7 % 50 END AS delay FROM events)"""


def _sprites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence for each 50 lines of the table: each of its 8 frames shows the same texture, two to the right and one down of where it was, on a still ground."""
    rows = raster.gray(spark, sf_dir).select(F.expr("y div 50").alias("anim"), F.expr("y % 50").alias("y"), F.slice("line", 1, 24).alias("t"))
    every = rows.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("frame", F.col("frame").cast("long"))
    moved = every.filter("y < 12").select("anim", "frame", F.expr("y + frame").alias("y"), "t")
    both = every.drop("t").join(moved, ["anim", "frame", "y"], "left")
    return both.select("anim", "frame", "y", F.expr("transform(sequence(0, 63), x -> coalesce(get(t, CAST(x - 2 * frame AS INT)), 0))").alias("line"))


def move_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes for moves between frames of every sequence."""
    return frames.move_votes(_sprites(spark, sf_dir))


MOVE_VOTES = (
    "WITH "
    + raster.PX
    + """,
s AS (SELECT y // 50 AS anim, y % 50 AS y, x, v0 FROM px),
fr AS (SELECT g.anim, f.frame, g.y, g.x, coalesce(t.v0, 0) AS v FROM (SELECT unnest(range(8)) AS frame) f CROSS JOIN s g LEFT JOIN s t ON t.anim = g.anim AND t.y = g.y - f.frame AND t.y < 12 AND t.x = g.x - 2 * f.frame AND t.x < 24),
p AS (SELECT a.anim, a.frame, a.y, a.x, a.v, [a.v, b.v, c.v, d.v] AS key FROM fr a JOIN fr b ON b.anim = a.anim AND b.frame = a.frame AND b.y = a.y AND b.x = a.x + 1 JOIN fr c ON c.anim = a.anim AND c.frame = a.frame AND c.y = a.y + 1 AND c.x = a.x JOIN fr d ON d.anim = a.anim AND d.frame = a.frame AND d.y = a.y + 1 AND d.x = a.x + 1),
o AS (SELECT anim, frame, key, min(y) AS oy, min(x) AS ox FROM p GROUP BY anim, frame, key HAVING count(*) = 1)
SELECT n.anim, n.frame, CAST(n.x - o.ox AS INT) AS dx, n.y - o.oy AS dy, count(*) AS votes FROM p n JOIN p w ON w.anim = n.anim AND w.frame = n.frame - 1 AND w.y = n.y AND w.x = n.x AND w.v <> n.v JOIN o ON o.anim = n.anim AND o.frame = n.frame - 1 AND o.key = n.key
WHERE n.x <> o.ox OR n.y <> o.oy GROUP BY ALL HAVING count(*) >= 4"""
)

QUERIES = {
    "palette_lex": palette_lex, "palette_luma": palette_luma, "index_histogram": index_histogram, "rle_runs": rle_runs, "index_runs": index_runs,
    "event_ranks": event_ranks, "scan_orders_cost": scan_orders_cost, "separable_test": separable_test, "separable_delta": separable_delta,
    "gray_model_slope": gray_model_slope, "gray_model_phase": gray_model_phase, "pattern_dictionary": pattern_dictionary, "block_refs": block_refs,
    "block_ops": block_ops, "block_scores": block_scores, "prefix_sum2d": prefix_sum2d, "frame_delta": frame_delta, "frame_types": frame_types,
    "frame_timeline": frame_timeline, "move_votes": move_votes,
}
ORACLES = {
    "palette_lex": PALETTE_LEX, "palette_luma": PALETTE_LUMA, "index_histogram": INDEX_HISTOGRAM, "rle_runs": RLE_RUNS, "index_runs": INDEX_RUNS,
    "event_ranks": EVENT_RANKS, "scan_orders_cost": _orders_sql(), "separable_test": SEPARABLE_TEST, "separable_delta": SEPARABLE_DELTA,
    "gray_model_slope": GRAY_MODEL_SLOPE, "gray_model_phase": GRAY_MODEL_PHASE, "pattern_dictionary": PATTERN_DICTIONARY, "block_refs": BLOCK_REFS,
    "block_ops": _ops_sql(), "block_scores": BLOCK_SCORES, "prefix_sum2d": PREFIX_SUM2D, "frame_delta": FRAME_DELTA, "frame_types": FRAME_TYPES,
    "frame_timeline": FRAME_TIMELINE, "move_votes": MOVE_VOTES,
}
