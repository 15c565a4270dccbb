"""Registered queries against their SQL on the smallest tables, and properties that SQL does not show."""

import os
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import formulas
from tessera.operators import colour, corpus, frames, neighbors, predict, structure
from tessera.plans import catalogue, structure_queries
from tessera.sources import raster

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")


def plain(v):
    return "null" if v is None or v != v else round(v, 9) if isinstance(v, float) else v


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = catalogue.QUERIES[name](spark, DATA)
    want = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(str([plain(v) for v in r]) for r in got.select(*columns).collect())
    assert rows == sorted(str([plain(v) for v in r]) for r in want.fetchall()) and rows


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_coded_queries_are_exact(spark, name):
    rows = catalogue.QUERIES[name](spark, DATA).collect()
    assert rows
    if "exact" in rows[0].asDict() and "files" not in rows[0].asDict():
        assert all(r.exact for r in rows)


def picture(spark, array, img=0):
    return spark.createDataFrame([(img, y, [int(v) for v in line]) for y, line in enumerate(array)], "img int, y long, line array<int>")


def around(a, half):
    """Neighbours by the plain rule."""
    h, w = a.shape
    for y in range(h):
        for x in range(w):
            W = a[y, x - 1] if x else a[y - 1, x] if y else half
            N = a[y - 1, x] if y else W
            yield (y, x, a[y, x], W, N, a[y - 1, x - 1] if x and y else N, a[y - 1, x + 1] if y and x + 1 < w else N, a[y, x - 2] if x > 1 else W, a[y - 2, x] if y > 1 else N)


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (9, 1), (300, 5), (3, 2)])
def test_stencil_over_bands(spark, shape):
    a = np.random.default_rng(1).integers(0, 256, shape)
    got = neighbors.stencil(picture(spark, a).repartition(3)).select("y", "x", "v", "W", "N", "NW", "NE", "WW", "NN").collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(int(v) for v in r) for r in around(a, 128))


def test_predictors_stay_in_range_but_for_rounding(spark):
    a = np.random.default_rng(2).choice([0, 1, 127, 128, 254, 255], (40, 30))
    st = neighbors.stencil(picture(spark, a))
    for family in (formulas.PREDICT_X, formulas.PREDICT_A, [formulas.GAP, formulas.RULE]):
        low, high = st.agg(F.least(*(F.min(predict._e(p)) for p in family), F.lit(999)), F.greatest(*(F.max(predict._e(p)) for p in family), F.lit(-999))).first()
        assert low >= 0 and high <= 255


def test_every_transform_is_undone_at_the_extremes(spark):
    values = [0, 1, 2, 127, 128, 254, 255]
    table = spark.createDataFrame([(r, g, b) for r in values for g in values for b in values], "r int, g int, b int")
    assert colour.round_trips(table).filter("mismatches > 0").isEmpty()


def test_pyramid_equals_large_tiles(spark):
    a = np.random.default_rng(3).integers(0, 256, (70, 45))
    st = neighbors.stencil(picture(spark, a))
    fine = predict.coarser(predict.tile_costs(st, formulas.PREDICT_A, 3), 1)
    assert sorted(map(str, fine.collect())) == sorted(map(str, predict.tile_costs(st, formulas.PREDICT_A, 4).select("img", "ty", "tx", "costs").collect()))


def test_scan_orders_are_orders():
    w, h = 7, 5
    for text in structure.ORDERS:
        seen = {eval(text.replace("CASE WHEN y % 2 = 1 THEN w - 1 - x ELSE x END", "(w - 1 - x if y % 2 else x)").replace("CASE WHEN x % 2 = 1 THEN h - 1 - y ELSE y END", "(h - 1 - y if x % 2 else y)"), {}, {"x": x, "y": y, "w": w, "h": h}) for x in range(w) for y in range(h)}  # noqa: S307
        assert seen == set(range(w * h))


def test_runs_cross_lines(spark):
    got = structure.runs(picture(spark, np.array([[1, 1, 2], [2, 2, 2], [2, 3, 3]]))).orderBy("y", "x").collect()
    assert [(r.y, r.x, r.v, r.n) for r in got] == [(0, 0, 1, 2), (0, 2, 2, 5), (2, 1, 3, 2)]


def test_patterns_repeat_odd_edges(spark):
    got = structure.patterns(picture(spark, np.array([[1, 1, 1], [1, 1, 1], [1, 1, 1]]))).collect()
    assert [(r.token, r.v0, r.v3, r.n) for r in got] == [(1, 1, 1, 4)]


def test_frame_kinds(spark):
    base = np.arange(64 * 16).reshape(16, 64) % 251
    changed = base.copy()
    changed[3:5, 7:9] += 1
    rows = [(0, f, y, [int(v) for v in line]) for f, a in enumerate((base, base, changed, 255 - base)) for y, line in enumerate(a)]
    got = {r.frame: r.kind for r in frames.kinds(spark.createDataFrame(rows, "anim int, frame long, y long, line array<int>")).collect()}
    assert got == {0: "key", 1: "duplicate", 2: "rectangle", 3: "key"}


def test_corpus_scalars(spark):
    rows = spark.createDataFrame([("a b/ç.png", 5.0, 0.0), ("__.jpg", 3.0, 2.0), ("x.tar.gz", 1.0005, 1.0)], "n string, v double, r double")
    got = rows.select(corpus.safe_stem(F.col("n")), corpus.percent(F.col("v"), F.col("r")), corpus.ratio(F.col("v"), F.col("r"))).collect()
    assert [tuple(r) for r in got] == [("a_b", 0.0, 0.0), ("image", 50.0, 1.5), ("x.tar", 0.05, 1.0)]


def test_pixel_difference(spark):
    one, two = picture(spark, np.array([[1, 2], [3, 4]])), picture(spark, np.array([[1, 5], [3, 4], [7, 7]]))
    cells = lambda t: t.select("img", "y", F.posexplode("line").alias("x", "v"))
    assert [r.mismatches for r in corpus.pixel_difference(cells(one), cells(two), "img", "y", "x").collect()] == [3]


@needs_data
def test_every_frame_is_round_tripped(spark):
    lines = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    rows = catalogue.QUERIES["roundtrip_anim"](spark, DATA).collect()
    assert len(rows) == len({(r.anim, r.frame) for r in rows}) == -(-lines // 32) and all(r.exact for r in rows)
    assert all(r.got_delay == r.frame * 10 or r.frame == 0 for r in rows) and max(r.frame for r in rows) < 8


@needs_data
def test_votes_cover_all_lines(spark):
    lines = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    rows = catalogue.QUERIES["move_votes"](spark, DATA).collect()
    assert {r.anim for r in rows if (r.dx, r.dy) == (2, 1)} == set(range(-(-lines // 50)))
    # a sequence by itself has the votes that it has among others
    alone = frames.move_votes(structure_queries._sprites(spark, DATA).filter("anim = 1")).collect()
    votes = lambda found: sorted((r.frame, r.dx, r.dy, r.votes) for r in found)
    assert votes(r for r in rows if r.anim == 1) == votes(alone) != []


@needs_data
def test_names_of_whole_texts(spark):
    stems = {r.doc_id: r.stem for r in catalogue.QUERIES["safe_names"](spark, DATA).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    assert stems.keys() == texts.keys() and all(re.fullmatch("[A-Za-z0-9._]+", s) for s in stems.values()) and max(map(len, stems.values())) > 1000


def test_what_separates(spark):
    rng = np.random.default_rng(5)
    a = (rng.integers(0, 256, (70, 1)) + rng.integers(0, 256, (1, 9))) & 255
    b = a.copy()
    b[40, 3] ^= 1
    both = picture(spark, a).unionByName(picture(spark, b, 1))
    samples = raster.pixels(both, "img", "y")
    assert {r.img: (r.mismatches, r.separable) for r in structure.separable(samples).collect()} == {0: (0, True), 1: (1, False)}
    sides = {(r.side, r.i): r.delta for r in structure.separable_deltas(samples.filter("img = 0")).collect()}
    want = {("row", i): v for i, v in enumerate(np.diff(a[0], prepend=0) & 255)} | {("column", i): v for i, v in enumerate(np.diff(a[:, 0], prepend=0) & 255)}
    assert sides == want


@pytest.mark.parametrize("span", [1, 7, 50, 1 << 16])
def test_events_over_parts(spark, monkeypatch, span):
    monkeypatch.setattr(structure, "SPAN", span)
    e = np.random.default_rng(span).choice([0, 0, 0, 0, 0, 0, 0, 0, 1, -3], (13, 11))
    rows = spark.createDataFrame([(0, y, x, int(v)) for (y, x), v in np.ndenumerate(e)], "img int, y int, x int, e int")
    price = lambda n: 1 if n == 0 else 2 * int(n).bit_length()
    costs = {r.scan: (r.n, r.cost) for r in structure.order_costs(rows, 11, 13).collect()}
    for scan, (lines, step) in {0: (e, 1), 1: (e.T, 1), 6: (e, -1), 7: (e.T, -1)}.items():
        flat = np.concatenate([line[::step] if i % 2 else line for i, line in enumerate(lines)])
        at = np.flatnonzero(flat)
        skips = np.diff(at, prepend=-1) - 1
        assert costs[scan] == (len(at), 4 + price(len(at)) + sum(price(s) + price(abs(v) - 1) + 1 for s, v in zip(skips, flat[at])))
        if scan == 0:
            got = structure.events(rows, structure.ORDERS[0], 11, 13).select("rank", "skip", "e").collect()
            assert sorted(map(tuple, got)) == [(int(a), int(s), int(flat[a])) for a, s in zip(at, skips)]


@pytest.mark.parametrize("span", [1, 5, 1 << 16])
def test_earlier_blocks_over_parts(spark, monkeypatch, span):
    monkeypatch.setattr(structure, "SPAN", span)
    kinds = np.random.default_rng(span).choice([0, 0, 0, 1, 2], 40)
    rows = spark.createDataFrame([(0, i // 4, i % 4, 2, 1, [int(k), 0]) for i, k in enumerate(kinds)], "img int, ty int, tx int, bw int, bh int, cells array<int>")
    got = {r.number: r.distance for r in structure.earlier_blocks(rows, "4").collect()}
    want = {i: next((i - j for j in range(i - 1, -1, -1) if kinds[j] == kinds[i]), None) for i in range(40)}
    assert got == want
