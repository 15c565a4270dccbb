"""Near duplicates against every pair."""

import random
import re

import numpy as np
import pytest

from tessera.llm import near_duplicates as nd
from tessera.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, k):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def plain(rows, k, percent=80):
    """component of each row, by comparing all pairs."""
    sets, comp = [plain_set(t, k) for _, t in rows], [d for d, _ in rows]
    changed = True
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if comp[i] is not None and comp[j] is not None and (rows[i][0] == rows[j][0] or (sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])))]
    while changed:
        changed = False
        for i, j in pairs:
            if comp[i] != comp[j]:
                comp[i] = comp[j] = min(comp[i], comp[j])
                changed = True
    return comp, [len(s) for s in sets]


def texts(seed, n, families):
    rng, rows = random.Random(seed), [None, "", " \n\t", "one", "One", "ONE\n", "é", "É", "a b", "A\tb", "b a", "x " * 3000, "x x"]
    for _ in range(families):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(5, 300))]
        for _ in range(rng.randint(1, n)):
            copy = [w if rng.random() > 0.05 else f"v{rng.randrange(9999)}" for w in base]
            rows.append((" " if rng.random() < 0.5 else "\n").join(copy))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k, shingles", [(2, 2_000_000), (5, 2_000_000), (2, 400)])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, k, shingles):
    monkeypatch.setattr(nd, "SHINGLES", shingles)
    rows = [(i, t) for i, t in enumerate(texts(k, 12, 40))] + [(7, "another text with this id"), (7, "a b"), (None, "a b"), (None, None)]
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, component_id int, rep string").repartition(4)
    got = nd.near_duplicates(docs, k).collect()
    comp, size = plain(rows, k)
    assert sorted(((d if d is not None else -1), c if c is not None else -1, n) for (d, _), c, n in zip(rows, comp, size)) == sorted(
        ((r.doc_id if r.doc_id is not None else -1), r.component_id if r.component_id is not None else -1, r.n_shingles) for r in got
    )
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert len(set(comp)) < len(rows)


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_link_equals_all_pairs():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 25))).astype(np.uint64) for _ in range(150)]
    got = nd.link(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), 80)
    comp, _ = plain([(i, " ".join(map(str, s))) for i, s in enumerate(sets)], 1)
    assert got.tolist() == comp


def test_link_from_some_sets_and_known_components():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 25))).astype(np.uint64) for _ in range(120)]
    ask = rng.random(120) < 0.3
    comp = np.where(ask, np.arange(120), 500)  # all that don't ask are connected
    got = nd.link(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), 80, comp, ask)
    words = [" ".join(map(str, s)) for s in sets]
    rest = int(np.flatnonzero(~ask)[0])
    want, _ = plain([(i, w) for i, w in enumerate(words)] + [(int(i), words[rest]) for i in np.flatnonzero(~ask)] + [(rest, w) for w, a in zip(words, ask) if not a], 1)
    assert got.tolist() == want[:120]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)}
