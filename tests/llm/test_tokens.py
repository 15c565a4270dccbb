"""Tokenization, token files and packing against plain loops over the tokenizer itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing, token_files, tokens

BYTE, WORD = (tokens.tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = ["", None, "a", "same text", "same text", "Ünïcode don't  stop.\n\n\tE.T. 12,5", "x " * 9000, "<|endoftext|> is special", "a   bİ'"]


def docs(spark):
    rows = [(i * 7 % 50, t, "clash", 1.0) for i, t in enumerate(TEXTS)] + [(None, "no key", "c", 2.0), (None, None, None, None), (14, "twice", "c", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, path string, start double").repartition(3)


def plain(path, text, end):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_units_equal_whole_encoding(path):
    rng, letters = random.Random(3), list("aB1é 'st’\n\t.,!?-_(ß<|>…́İΣ漢½​\xa0\x0b\x85ा") + ["'s", "'LL", " ", "\n\n", "<|endoftext|>"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]
    encoder = tokens.Encoder(path)
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == encoder.whole(texts)


def test_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 5)
    encoder, texts = tokens.Encoder(BYTE), ["one two three four five six seven", "one nine", "two ten one", ""] * 3
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == encoder.whole(texts)


def test_key_index_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 20_000))
    index = token_files.KeyIndex.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    assert token_files.KeyIndex.build(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]


def test_token_files_round_trip(spark):
    manifest = token_files.write_ids(docs(spark), BYTE, 0)
    got = token_files.read_ids(manifest).withColumn("n", F.octet_length("ids") / 4).orderBy("start").collect()
    want = sorted(docs(spark).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    at = 0
    for g, w in zip(got, want, strict=True):
        ids = plain(BYTE, w.text, 0)
        assert (g.doc_id, g.start, np.frombuffer(g.ids, "<u4").tolist()) == (w.doc_id, at, ids)
        at += len(ids)
    shards = [token_files.Shard(r.path) for r in manifest.collect()]
    assert sum(len(s.get(14)) for s in shards) == sum(r.doc_id == 14 for r in want)
    assert not any(s.get(12345) for s in shards)
    assert token_files.read_ids(token_files.write_ids(docs(spark).limit(0), BYTE, 0)).count() == 0


@pytest.mark.parametrize("together", [8 << 20, 300])
def test_packing_covers_every_id_once(spark, monkeypatch, together):
    monkeypatch.setattr(packing, "TOGETHER", together)
    got = packing.pack(docs(spark), WORD, 2, 64).collect()
    assert packing.pack(docs(spark).limit(0), WORD, 2).count() == 0
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    padded = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 64
        padded += 64 - at if at & (at - 1) else 0
    assert padded < sum(r.length for r in got) / 16
    want = {}
    for r in docs(spark).collect():
        want.setdefault(r.doc_id, []).append(plain(WORD, r.text, 2))
    assert sum(r.length for r in by_doc[None]) == sum(map(len, want[None])) and sum(r.length for r in by_doc[14]) == sum(map(len, want[14]))
    for key, texts in want.items():
        if len(texts) > 1:
            continue
        at, ids = 0, texts[0]
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_emptier_windows_become_powers_of_two():
    rng = np.random.default_rng(8)
    for lengths in (rng.integers(33, 60, 40), np.full(9, 37), np.array([1]), rng.integers(1, 65, 200)):
        window, offset, used = packing.best_fit_decreasing(lengths, 64)
        parts, now = packing.divided(window, offset, lengths, used, 64)
        fill = np.zeros(now, int)
        for i, first, n, w, at in sorted(parts, key=lambda p: (p[3], p[4])):
            assert fill[w] == at and n > 0
            fill[w] += n
        assert all(f >= 60 or f & (f - 1) == 0 for f in fill.tolist()) and fill.min() > 0
        for i, n in enumerate(lengths):
            own = sorted((p[1], p[2]) for p in parts if p[0] == i)
            assert sum(k for _, k in own) == n and all(a + b == c for (a, b), (c, _) in zip(own, own[1:]))


def test_best_fit_decreasing_takes_the_tightest_window():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 65, 500)
    window, offset, used = packing.best_fit_decreasing(lengths, 64)
    rooms = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in rooms if r >= lengths[i]]
        rooms.remove(room) if (room := min(fits, default=None)) is not None else None
        assert 64 - offset[i] == (64 if room is None else room)
        rooms.append((64 if room is None else room) - lengths[i])
    assert used == len(rooms) and lengths.sum() > 0.97 * 64 * used
