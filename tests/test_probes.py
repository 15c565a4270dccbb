"""Block models and probes against plain loops."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import block_models, predict, probes, regions, structure


def picture(spark, a, img=0):
    return spark.createDataFrame([(img, y, [int(v) for v in line]) for y, line in enumerate(a)], "img int, y long, line array<int>")


def sample(h=37, w=41):
    rng = np.random.default_rng(5)
    y, x = np.mgrid[:h, :w]
    return ((3 * x + 2 * y + rng.integers(0, 9, (h, w))) * (x < 24) + rng.integers(0, 256, (h, w)) * (x >= 24)).astype(int) & 255


def test_block_models_equal_the_kernel(spark):
    a = sample()
    rows, planes = picture(spark, a), [a.tolist()]
    blocks, trials = (t.collect() for t in block_models.weights(rows))
    best = {(r.ty, r.tx): r for r in block_models.pdm_weights(rows).collect()}
    chosen = {(r.ty, r.tx): r for r in block_models.block_scores(rows).collect()}
    assert len(blocks) == 9 == len(best) == len(chosen)
    for b in blocks:
        x0, y0 = 16 * b.tx, 16 * b.ty
        w, h = min(16, 41 - x0), min(16, 37 - y0)
        flat, corners, left, up = regions.measured(planes, x0, y0, w, h, 16)

        def cost(op, params):
            guess = regions.predictor(b"QBL2", op, params, planes, 0, x0, y0, w, h)
            return 20 * (1 + len(params)) + sum(regions.score((int(a[y, x]) - guess(x, y)) & 255) for y in range(y0, y0 + h) for x in range(x0, x0 + w))

        ops = {"zero": (0, b""), "flat": (1, flat), "gradient": (2, corners), "left": (3, left), "up": (4, up), "causal": (5, b"")}
        costs = {}
        for name, (op, params) in ops.items():
            if (name == "left" and not x0) or (name == "up" and not y0):
                assert b[f"s_{name}"] is None
                continue
            costs[op] = cost(op, params)
            assert b[f"s_{name}"] + 20 * (1 + len(params)) == costs[op], name
        m = best[b.ty, b.tx]
        q = (m.q0, m.q1, m.q2, m.q3, m.q4)
        assert m.score == cost(regions.MIXTURE, regions.packed(q) + flat + corners + left + up) == min(t.score for t in trials if (t.ty, t.tx) == (b.ty, b.tx))
        if m.used:
            costs[6] = m.score
        op = min(costs, key=lambda k: (costs[k], k))
        assert (chosen[b.ty, b.tx].op, chosen[b.ty, b.tx].score) == (op, costs[op])


def test_block_probe(spark):
    a = np.random.default_rng(1).integers(0, 256, (80, 64))
    a[:16, :16] = 7
    a[16:32, 16:32] = a[32:48, 48:64]
    a[64:, :16] = np.arange(16) % 4
    got = probes.block_probe(structure.blocks(picture(spark, a)), 4).collect()
    assert [(r.sampled, r.useful, r.worth) for r in got] == [(20, 3, True)]
    assert [r.worth for r in probes.block_probe(structure.blocks(picture(spark, a[:48])), 4).collect()] == [False]


def test_explicit_ids(spark):
    ids = np.random.default_rng(2).integers(0, 3, (9, 7))
    tiles = spark.createDataFrame([(0, y, x, int(v)) for (y, x), v in np.ndenumerate(ids)], "img int, ty int, tx int, id int")
    want = 0
    for (y, x), v in np.ndenumerate(ids):
        left, up = (ids[y, x - 1] if x else None), (ids[y - 1, x] if y else None)
        want += not (left is not None and v == left) and not (up is not None and v == up and (left is None or up != left))
    (got,) = probes.explicit_ids(tiles).collect()
    assert (got.tiles, got.explicit, got.worth) == (63, want, want * 100 >= 63 * 25)


def test_choice_in_context_keeps_tiles_alike(spark):
    rng = np.random.default_rng(3)
    costs = rng.integers(0, 60, (6, 5, 8))
    rows = [(img, y, x, [int(c) for c in costs[y, x]]) for img in (0, 1) for y in range(6) for x in range(5)]
    table = spark.createDataFrame(rows, "img int, ty int, tx int, costs array<long>").repartition(3)
    for penalty in (0, 4):
        chosen = np.zeros((6, 5), int)
        for y in range(6):
            for x in range(5):
                total = costs[y, x].astype(int).copy()
                for p in range(8):
                    if x and p != chosen[y, x - 1]:
                        total[p] += penalty * (5 if not y or chosen[y - 1, x] == chosen[y, x - 1] or p != chosen[y - 1, x] else 1)
                    elif not x and y and p != chosen[y - 1, x]:
                        total[p] += 5 * penalty
                chosen[y, x] = total.argmin()
        got = predict.cheapest_in_context(table, penalty).collect()
        assert {(r.img, r.ty, r.tx): r.id for r in got} == {(img, y, x): int(chosen[y, x]) for img in (0, 1) for y in range(6) for x in range(5)}


def test_region_and_bases(spark):
    a = sample()
    cut = probes.region(picture(spark, a), 3, 5, 10, 8).orderBy("y").collect()
    assert [r.line for r in cut] == a[5:13, 3:13].tolist() and [r.y for r in cut] == list(range(8))
    for r in probes.block_bases(structure.blocks(picture(spark, a % 5))).collect():
        cells = (a % 5)[16 * r.ty : 16 * r.ty + 16, 16 * r.tx : 16 * r.tx + 16].ravel()
        n = np.bincount(cells, minlength=5)
        assert (r.base, r.n) == (n.argmax(), n.max())
    kinds = probes.gray_kinds(picture(spark, a), 3).select("kinds", "few").collect()
    assert [tuple(r) for r in kinds] == [(len(np.unique(a)), False)]
    assert probes.gray_kinds(picture(spark, a).filter(F.lit(False))).count() == 0
