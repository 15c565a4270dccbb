"""Quality rules and mixing against plain Python."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import mixing, quality_rules
from tessera.llm.words import blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, "   \n\n", "one", "a b c d e f g h a b c d e f g h i", "x\nx\n\nx y\nx\r\n x", "é à 日本 #$ <b> z", "w " * 5000, "\n".join(["l l"] * 30), "p q r s t u v w " * 3]


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(hit)]


def test_stats_equal_plain_python():
    rng = np.random.default_rng(5)
    random = ["".join(rng.choice(list("ab \n#é"), n)) for n in rng.integers(0, 300, 400)]
    column = pa.array(TEXTS + random)
    got = [np.stack(quality_rules.text_stats(buf, off), 1) for _, _, buf, off in blocks(column, 2000)]
    assert np.concatenate(got).tolist() == [plain(t) for t in column.to_pylist()]


def table(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "fr", "s", 1), (3, "one", "en", "s", 1)]
    usual = [(1000 + i, " ".join(f"word{i * j % 97}x" for j in range(1, 60)), "en", "s", 1) for i in range(700)]
    odd = [(5000, " ".join(f"w{j}$$$" for j in range(60)), "en", "s", 1)]
    return spark.createDataFrame(rows + usual + odd, "doc_id long, text string, lang string, source string, n_words int").repartition(4)


def test_judge(spark):
    got = quality_rules.judge(table(spark)).collect()
    texts = Counter((r.doc_id, *plain(r.text)) for r in table(spark).collect())
    assert texts == Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in got)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    usual = [r.kept for r in got if r.doc_id and 1000 <= r.doc_id < 2000 and not r.base_failed]
    assert len(usual) > 300 and all(usual)
    assert [r.kept for r in got if r.doc_id == 5000] == [False]
    assert quality_rules.judge(table(spark).limit(0)).count() == 0


def waterfill(sizes, weights):
    total, stopped = sum(sizes), set()
    while True:
        rest = total - sum(3 * sizes[i] for i in stopped)
        among = sum(w for i, w in enumerate(weights) if i not in stopped)
        share = [3 * s if i in stopped else rest * w / among for i, (s, w) in enumerate(zip(sizes, weights))]
        above = {i for i in range(len(sizes)) if i not in stopped and share[i] >= 3 * sizes[i]}
        if not above:
            return share
        stopped |= above
        if len(stopped) == len(sizes):
            return [3 * s for s in sizes]


def test_mix(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), " ".join(["w"] * int(rng.integers(0, 50))), s, 5) for i, s in enumerate(rng.choice(["a", "b", "c", "d", "é"], 600, p=[0.6, 0.3, 0.05, 0.04, 0.01]))]
    rows += [(None, None, None, 1), (5, "x y", "a", 1), (5, "x y", "a", 1), (7000, "a b c", None, 2), (7001, "", "empty", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int").repartition(5).selectExpr("*", "'h' AS _h", "7 AS want", "doc_id AS _in", "source AS _s", "1 AS _texts")
    got = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len((r[1] or "").split()) for r in rows if r[2] == s) for s in sources]
    want = dict(zip(sources, waterfill(sizes, [1 + i % 3 for i in range(len(sources))])))
    taken = Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.taken <= 3 * r.size and r.size == len((r.text or "").split())
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sources)
    assert mixing.repeated(mixing.mix(docs)).select(F.sum(mixing.n_words("text"))).first()[0] == sum(taken.values())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_small_groups_follow_their_own_sketch(spark):
    """Quartiles of the merged sketches against plain counting, for groups of 1 to 400 documents; the same documents twice over move a
    group's fence toward its own values, with no size at which another sketch takes over."""
    rng = np.random.default_rng(7)
    names = [f.split()[0] for f in quality_rules.STATS.split(", ")]

    def table_of(copies):
        rows = []
        for s, (n, usual) in enumerate([(1, 900), (3, 900), (30, 700), (120, 400), (400, 100)]):
            for v in rng.integers(usual - 20, usual + 20, n).tolist():
                rows += [("en", f"s{s}", dict(zip(names, (100, v, 0, 1, 0, 0))), False)] * copies
        return rows

    low = {}
    for copies in (1, 2, 20):
        rng = np.random.default_rng(7)
        rows = table_of(copies)
        stats = spark.createDataFrame([(a, b, *(d[k] for k in names), f) for a, b, d, f in rows], f"lang string, source string, {quality_rules.STATS}, base_failed boolean")
        got = {r.source: r for r in quality_rules.fences(stats).collect()}
        bucket = lambda v: v if v < 64 else v >> v.bit_length() - 6 << v.bit_length() - 6
        every = Counter(bucket(d["word_chars"]) for *_, d, _ in rows)
        total = sum(every.values())
        for source in got:
            own = Counter(bucket(d["word_chars"]) for _, s, d, _ in rows if s == source)
            language = {v: n * total + quality_rules.PRIOR * n for v, n in every.items()}  # one language: its sketch is everyone's
            whole = sum(language.values())
            mix = sorted((v, own[v] * whole + quality_rules.PRIOR * n) for v, n in language.items())
            upto = np.cumsum([n for _, n in mix], dtype=object)
            q1, q3 = (next(v for (v, _), u in zip(mix, upto) if 4 * u >= p * upto[-1]) for p in (1, 3))
            spread = max(q3 - q1, 40)
            assert (got[source].word_length_low, got[source].word_length_high) == (q1 - 8 * spread, q3 + 8 * spread)
        low[copies] = got["s3"].word_length_low
    assert low[1] <= low[2] <= low[20]
