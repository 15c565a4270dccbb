"""The byte network: pooling against a loop over chunks, learning and scoring on a made-up task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_classifier as qc


def plain(net, text):
    padded = qc._pad(text)
    best = np.full(qc.FILTERS, -np.inf)
    for a in range(0, len(padded) - qc.WIDTH + 1, qc.STEP):
        best = np.maximum(best, net.bytes_[padded[a : a + qc.WIDTH]].ravel() @ net.filters)
    return 1 / (1 + np.exp(-(np.maximum(best + net.bias, 0) @ net.weights + net.base[0])))


@pytest.mark.parametrize("slice_", [512 << 10, 64])
def test_scores_equal_a_loop_over_chunks(monkeypatch, slice_):
    monkeypatch.setattr(qc, "SLICE", slice_)
    net, rng = qc.Network.fresh(1), np.random.default_rng(2)
    texts = [rng.integers(32, 127, n).astype(np.uint8).tobytes() for n in (0, 1, 4, 7, 8, 9, 64, 65, 500, 0, 3, 130)]
    texts += [b"word word word word", b"word word word word", b"again and again and again and", b"ab", b"ab", b"ab" * 200]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = net.score(np.frombuffer(b"".join(texts), np.uint8), off)
    assert np.allclose(got, [plain(net, t) for t in texts], atol=1e-5)


def test_marks_tell_repeats_within_a_text():
    texts = [b"abcdef abcdef", b"abcdef", b"abcdefg" + b"." * 60 + b"abcdefg"]
    padded = [qc._pad(t) for t in texts]
    marks = [[bool(v > 255) for v in p] for p in padded]
    assert [i for i, m in enumerate(marks[0]) if m] == [7] and not any(marks[1])
    assert not any(marks[2][67:]) and all(marks[2][8:60])
    joined = qc.marked(np.concatenate([p & 255 for p in padded]).astype(np.uint8), np.concatenate([[0], np.cumsum(list(map(len, padded)))]))
    assert joined.tolist() == [v for p in padded for v in p.tolist()]


def table(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(700):
        text = " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(rng.integers(10, 80)))
        rows.append((i, text if i % 4 else text.replace(" ", "$$$ ", 9), 1.0))
    extra = [(9000, "", 1.0), (9001, None, 1.0), (None, "no id", 1.0), (9002, "z" * 100_000, 1.0), (3, "again", 1.0)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(700)] + [(9001, 1, 0), (None, 1, 0), (5, None, 0), (12345, 0, 0)]
    return spark.createDataFrame(rows + extra, "doc_id long, text string, score double").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, text int")


def test_learns_and_scores_every_row(spark):
    docs, labels = table(spark)
    net = qc.fit(docs, labels)
    again = qc.fit(docs.repartition(2), labels)
    assert all(np.array_equal(a, b) for a, b in zip(vars(net).values(), vars(again).values()))
    got = qc.scored(docs, net).withColumn("held", qc.held_out()).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held and r.doc_id is not None and r.doc_id < 700]
    assert len(held) > 100 and sum((r.score >= 0.5) == (r.doc_id % 4 > 0) for r in held) > 0.95 * len(held)
    assert qc.scored(docs.limit(0), net).count() == 0
    assert qc.scored(docs, qc.fit(docs, labels.limit(0))).filter(F.col("score").isNull()).count() == 0
