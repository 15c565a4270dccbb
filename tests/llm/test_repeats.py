"""Removal of repeated strings against a dictionary of all strings."""

import random
import re
from collections import Counter

import pytest

from tessera.llm import repeats


def plain(texts, width):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - width + 1):
            if count[d[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), runs, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def texts(width):
    rng = random.Random(width)
    word = lambda n, letters="abcdé \n": "".join(rng.choices(letters, k=n))
    passages = [word(rng.randint(width // 2, 3 * width)) for _ in range(6)]
    out = [None, "", "x", "a" * (5 * width), "ab" * width, "a" * (width - 1), "a" * width, word(9000), word(9000)]
    for _ in range(60):
        out.append("".join(rng.choice(passages) if rng.random() < 0.4 else word(rng.randint(1, width)) for _ in range(rng.randint(1, 6))))
    for i in range(5):
        copy = list(out[7])
        for _ in range(i):
            copy[rng.randrange(len(copy))] = "Z"
        out.append("".join(copy))
    return out


@pytest.mark.parametrize("width, hot, segment", [(60, 8192, 4 << 20), (60, 3, 700), (400, 8192, 4 << 20), (131, 2, 5000)])
def test_remove_repeats(spark, monkeypatch, width, hot, segment):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    monkeypatch.setattr(repeats, "RANGE", 100 if hot == 3 else 2048)
    monkeypatch.setattr(repeats, "GRAM", 20 if hot == 3 else 100)
    rows = list(enumerate(texts(width))) + [(3, "same id"), (None, "no id"), (None, None), (2, "twice in full" * 40), (2, "twice in full" * 40)]
    docs = spark.createDataFrame([(d, t, 5, "y") for d, t in rows], "doc_id long, text string, start int, kept string").repartition(4)
    got = repeats.remove_repeats(docs, width).collect()
    want = [(d if d is not None else -1, *x) for (d, _), x in zip(rows, plain([t for _, t in rows], width))]
    assert sorted(want) == sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got)
    assert sum(x[2] for x in want) > 10_000


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shared_grams_without_a_repeated_string(spark):
    rng = random.Random(1)
    gram = "".join(rng.choices("abcdef", k=120))
    rows = [(i, "".join(rng.choices("ghijk", k=300)) + gram + "".join(rng.choices("lmnop", k=300))) for i in range(6)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 400).collect()
    assert len(got) == 6 and all(r.n_removed == 0 and bytes(r.kept).decode() == dict(rows)[r.doc_id] for r in got)


def plain_words(texts, n):
    found = [list(re.finditer(r"[^\x20\x09-\x0D]+", t or "", re.ASCII)) for t in texts]
    count = Counter(tuple(m.group() for m in ms[i : i + n]) for ms in found for i in range(len(ms) - n + 1))
    out = []
    for t, ms in zip(texts, found):
        gone, inside = [False] * len(t or ""), set()
        for i in range(len(ms) - n + 1):
            if count[tuple(m.group() for m in ms[i : i + n])] > 1:
                gone[ms[i].start() : ms[i + n - 1].end()] = [True] * (ms[i + n - 1].end() - ms[i].start())
                inside |= set(range(i, i + n))
        out.append(("".join(c for c, g in zip(t or "", gone) if not g).encode(), len(inside)))
    return out


@pytest.mark.parametrize("hot, segment, span", [(8192, 4 << 20, 2048), (2, 700, 5), (8192, 300, 2048)])
def test_passages_of_words(spark, monkeypatch, hot, segment, span):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    monkeypatch.setattr(repeats, "RANGE", span)
    rng = random.Random(hot + segment)
    some = lambda n: [rng.choice("abé") * rng.randint(1, 3) + rng.choice("xyz") for _ in range(n)]
    passages = [some(rng.randint(10, 40)) for _ in range(5)]
    texts_ = [None, "", " x ", "na " * 13, "na " * 12, "\n".join(some(900))]
    for _ in range(50):
        words_ = [w for _ in range(rng.randint(1, 5)) for w in (rng.choice(passages) if rng.random() < 0.5 else some(rng.randint(1, 15)))]
        texts_.append("".join(w + rng.choice([" ", "\n", "\t  "]) for w in words_))
    docs = spark.createDataFrame([(i, t, -1, "x", i) for i, t in enumerate(texts_)], "doc_id long, text string, _key int, _spans string, _d long").repartition(4)
    got = {r.doc_id: (bytes(r.kept), r.n_passage_words) for r in repeats.remove_repeats(docs, 100_000, 12).collect()}
    want = plain_words(texts_, 12)
    assert got == dict(enumerate(want)) and sum(len((t or "").encode()) - len(w) for t, (w, _) in zip(texts_, want)) > 2000
    marked = repeats.remove_repeats(docs, 100_000, 12, cut=False).collect()
    assert all(bytes(r.kept) == (texts_[r.doc_id] or "").encode() and r.n_passage_words == want[r.doc_id][1] and r._key == -1 and r._spans == "x" and r._d == r.doc_id for r in marked)
