"""Ranges whose polynomial hashes modulo a power of two meet, and hashes that are made to meet: nothing different may count as equal."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import near_duplicates, quality_rules, repeats, tokens
from tessera.llm import words as ww
from test_repeats import plain


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


ONE, OTHER = thue_morse(1024), thue_morse(1024, "b", "a")


def block(*texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data])


@pytest.fixture(params=[False, True], ids=["as it is", "hashes of 3 bits"])
def weak(request, monkeypatch):
    if request.param:
        span = ww.span
        monkeypatch.setattr(ww, "span", lambda *a, **k: span(*a, **k) & ww.U64(7))


def test_sums_equal_whole_number_arithmetic():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, ww.PRIME, (2, 500), dtype=np.uint64)
    a[:3] = b[:2] = ww.PRIME - 1
    assert [int(x) for x in ww.times(a, b)] == [int(x) * int(y) % ww.PRIME for x, y in zip(a, b)]
    for base, values in ((0, rng.integers(0, 256, 70_000).astype(np.uint8)), (1, rng.integers(0, ww.PRIME, 70_000, dtype=np.uint64))):
        got, total, power = ww.prefix(values, base), 0, 1
        for i, v in enumerate(values.tolist()):
            assert int(got[i]) == total
            total, power = (total + (v + 1) * power) % ww.PRIME, power * ww.BASES[base] % ww.PRIME


def test_numbers_are_equal_only_for_equal_bytes(weak):
    rng = random.Random(1)
    words = [ONE, OTHER, ONE + "x", "x" * 17, "x" * 16 + "y", *("".join(rng.choices("ab", k=rng.randint(1, 30))) for _ in range(3000))] * 2
    rng.shuffle(words)
    buf, off = block(*words)
    one, kind = ww.numbered(buf, off[:-1], off[1:])
    assert len(one) == len(set(words)) == len(set(zip(words, kind.tolist()))) == len(set(kind.tolist()))
    assert all(words[one[k]] == w for w, k in zip(words, kind.tolist()))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_units(name, weak):
    texts = [f"hello abcdefgh{w}abcdefgh" for w in (ONE, OTHER, ONE)]
    encoder = tokens.Encoder(tokens.tokenizer_path(name))
    for column in (texts, texts[::-1], texts[1:]):
        assert [x.tolist() for x in encoder.encode(pa.array(column))] == encoder.whole(column)


def test_lines_and_words_of_quality_rules(weak):
    eight = lambda w: f"{w} b c d e f g h\n"
    stats = quality_rules.text_stats(*block(f"{ONE}\n{OTHER}\n{ONE}", eight(ONE) + eight(OTHER), eight(ONE) + eight(ONE)))
    assert stats[4].tolist() == [1, 0, 1] and stats[5].tolist() == [0, 0, 16]


@pytest.mark.parametrize("k", [2, 5])
def test_shingles(k):
    texts = [f"{w} z y x v" for w in (ONE, OTHER, ONE.upper())] + ["z", "Z", ONE, "", "a a a a a a a a"]
    for sets, at in (near_duplicates.shingle_sets(*block(*texts), k), near_duplicates.exact_sets(pa.array(texts), k)):
        found = [tuple(sorted(sets[a:b].tolist())) for a, b in zip(at[:-1], at[1:])]
        assert found[0] == found[2] != found[1] and found[3] == found[4] != found[5] and [len(f) for f in found] == [6 - k] * 3 + [1, 1, 1, 0, 1]


@pytest.mark.parametrize("hot", [8192, 0])
def test_repeated_strings_and_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    gap = "<" * 100
    # the least gram of many strings is one that all share, and what stands around it differs by swapped letters alone
    rows = [(0, gap + ONE[:512] + gap), (1, gap + OTHER[:512] + gap), (2, f"{ONE[:300]} c d e f {OTHER[:300]}"), (3, f"{OTHER[:300]} c d e f {ONE[:300]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.remove_repeats(docs, 400, 6).collect()
    want = plain([t for _, t in rows], 400)
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(i, w[1]) for i, w in enumerate(want)] and want[0][1] == 0
