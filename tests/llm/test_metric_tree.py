"""Exact top-k against a full matrix product."""

import numpy as np
import pytest

from tessera.llm import metric_tree as mt


def plain(rows, k, every):
    rows = {(i, tuple(int(np.floor(64 * float(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, v in rows:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("leaf, candidates", [(256, 8192), (4, 150)])
def test_top_k_equals_all_scores(spark, monkeypatch, leaf, candidates):
    for name, value in (("LEAF", leaf), ("CANDIDATES", candidates)):
        monkeypatch.setattr(mt, name, value)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(5, 6))
    rows = [(i, [float(x) for x in centres[i % 5] + 0.1 * rng.normal(size=6)]) for i in range(500)]
    rows += [(500 + i, [0.25] * 6) for i in range(200)]
    rows += [(40, rows[3][1]), (40, rows[3][1]), (None, [1.0] * 6), (800, None), (801, []), (802, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (803, [float("nan")] * 6), (804, [float("inf")] * 6), (820, [0.5, 0.5]), (821, [0.1, -0.5])]
    table = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    kept = [(r.vec_id, r.embedding) for r in table.collect()]
    assert sorted(tuple(r) for r in mt.top_k(table, 7).collect()) == plain(kept, 7, 20)
    assert mt.top_k(table.limit(0)).count() == 0


def test_search_passes_pages_over(monkeypatch):
    monkeypatch.setattr(mt, "LEAF", 128)
    rng = np.random.default_rng(1)
    x = np.floor(64 * (np.eye(8)[rng.integers(0, 8, 5000)] + 0.02 * rng.normal(size=(5000, 8))))
    root = mt.build(x, np.arange(5000), x.mean(0))
    looked = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            looked.append(len(self))
            return np.asarray(self) @ other

    def wrap(node):
        node.pivots = node.pivots.view(Counted)
        for c in node.children:
            wrap(c)

    wrap(root)
    scores, ids = mt.search(root, x.mean(0), x[0], 0, 10)
    assert sum(looked) < 2500 and sorted(-scores) == sorted(-np.delete(x @ x[0], 0))[:10]
    first, kth = sum(looked), float(scores[-1])
    looked.clear()
    again, same = mt.search(root, x.mean(0), x[0], 0, 10, kth)
    assert sum(looked) <= first and again.tolist() == scores.tolist() and same.tolist() == ids.tolist()
    assert len(mt.search(root, x.mean(0), x[0], 0, 10, kth + 1)[0]) < 10
