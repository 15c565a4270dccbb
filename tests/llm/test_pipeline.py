"""The pipeline's stages against plain Python on a small table."""

import random
from collections import Counter

import corpus_pipeline as cp
from pyspark.sql import functions as F
from test_near_duplicates import plain as plain_groups
from test_repeats import plain as plain_repeats
from test_rules_and_mixing import WORD, waterfill
from test_tokens import WORD as WORD_BPE
from test_tokens import plain as plain_ids


def folder(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghé", k=rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(120))
    rows = []
    for i in range(240):
        words = [word() for _ in range(rng.randint(20, 200))]
        if i % 6 == 0:
            words = [w + "$$$" for w in words]
        if i % 7 == 1:
            words[5:5] = passage.split()
        rows.append((i, " ".join(words), "en", f"s{i % 5}"))
    rows += [(300 + i, rows[i][1] + " end", "en", "s9") for i in range(1, 30)] + [(400, rows[7][1], "fr", None), (401, None, None, None), (402, "", "en", "s1")]
    docs = [(i, t, a, b, len(t or "")) for i, t, a, b in rows]
    path = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 6 > 0), 0) for i in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_every_stage(spark, tmp_path):
    path = folder(spark, tmp_path)
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in cp.STAGES:
        rows = [tuple(r) for r in docs.collect()]
        docs = cp.written(stage(spark, docs, path), name)
        seen.append((rows, [tuple(r) for r in docs.collect()]))
    assert sum(r[2] for r in seen[-1][1]) == sum(r.length for r in cp.run(spark, path).collect())
    before, after = seen[0]
    assert set(after) <= set(before)
    assert {r[0] for r in after if r[0] < 240} >= {i for i in range(240) if i % 6} and sum(r[0] % 6 == 0 for r in after if r[0] < 240) < 3
    before, after = seen[1]
    comp, _ = plain_groups([(r[0], r[1]) for r in before], 5)
    assert sorted(map(str, after)) == sorted(str(r) for r, c in zip(before, comp) if r[0] == c)
    before, after = seen[2]
    left = {r[0]: (x[3].decode(errors="ignore") if x[1] else r[1]) for r, x in zip(before, plain_repeats([r[1] for r in before], 400))}
    assert {r[0]: (r[1], r[4]) for r in after} == {k: (v, None if v is None else len(v)) for k, v in left.items()}
    assert sum(len(left[r[0]] or "") < len(r[1] or "") for r in before) > 5
    before, after = seen[3]
    sources = sorted({r[3] for r in before}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(WORD.findall(r[1] or "")) for r in before if r[3] == s) for s in sources]
    taken = Counter()
    for r in after:
        taken[r[3]] += len(WORD.findall(r[1] or ""))
    assert all(abs(taken[s] - w) <= 1 for s, w in zip(sources, waterfill(sizes, [1 + i % 3 for i in range(len(sources))])))
    assert max(Counter(r[0] for r in after).values()) <= 3
    before, after = seen[4]
    want = Counter()
    for r in before:
        want[r[0]] += len(plain_ids(WORD_BPE, r[1], 2))
    got = Counter()
    for r in after:
        got[r[0]] += r[2]
    assert want == got
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").isEmpty()


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "a b c d e f", None, "s", 3), (1, "", "en", None, 0), (1, "same id " * 300, "en", "s", 9), (2, "é" * 30_000, "en", "s", 1), (2, "é" * 30_000, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, None), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() > 0


def test_passages_of_51_words(spark):
    rng = random.Random(3)
    word = lambda n=6: "".join(rng.choices("abcdefghijkl", k=n))
    passages, short = {n: " ".join(word(n) for _ in range(51)) for n in (2, 5, 6)}, " ".join(word() for _ in range(50))
    own = lambda: " ".join(word() for _ in range(30))
    rows, left = [], {}
    for i, p in enumerate([*passages.values(), passages[5].replace(" ", "\n "), short] * 2):
        a, b = own(), own()
        rows.append((i, f"{a} {p} {b}", "en", "s", 0))
        left[i] = f"{a} {p} {b}" if p is short else f"{a}  {b}"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: " ".join(r.text.split()) for r in cp.without_repeats(spark, docs, "").collect()}
    assert all(len(p.encode()) < 400 for p in passages.values())
    assert got == {k: " ".join(v.split()) for k, v in left.items()}
