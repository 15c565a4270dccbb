"""Quality rules whose limits adapt to each language and source.

A text's counts come from one pass over its bytes. Ratios of them, as whole numbers, go into a sketch for each language and
source: counts by value, where values from 64 up share a bucket with those that agree in the first six bits. Sketches merge
by adding counts, in any order and with the same result, so every executor adds up before the exchange. A group's sketch is merged
with that of its language, and a language's with everyone's, each scaled to `PRIOR` documents: what a group shows weighs the more
the larger it is, at every size by the same rule. Quartiles read from the merged sketch give fences far outside the usual values;
a join brings them back to the documents. A group of clean documents loses none, as fences follow the group's own spread.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import words as ww
from tessera.llm.common import written

STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: Metric: the whole-number ratio, how far (in spreads between the quartiles) a fence lies above or below, the least spread.
METRICS = {
    "symbols": ("1000 * n_symbols div greatest(word_chars, 1)", 6, 6, 5),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", 6, 6, 50),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", 6, 6, 30),
    "word_length": ("100 * word_chars div greatest(n_words, 1)", 8, 8, 40),
}
#: Documents that the wider sketch counts for beside a group's own.
PRIOR = 200
WHOLE = "decimal(38,0)"


def _per_text(totals: np.ndarray, off: np.ndarray) -> np.ndarray:
    return totals[off[1:]] - totals[off[:-1]]


def _running(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def text_stats(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The columns of STATS for a block of texts."""
    n = len(off) - 1
    start, end, first = ww.words(buf, off)
    chars = _per_text(_running(((buf & 0xC0) != 0x80) & ~ww.SPACE[buf]), off)
    symbols = _per_text(_running(SYMBOL[buf]), off)
    # lines: cut behind each \n and at the ends of texts; only those with a word count
    cut = np.flatnonzero(buf == 10)
    edge = np.zeros(len(buf) + 1, bool)
    edge[cut + 1] = edge[off] = True
    edges = np.flatnonzero(edge)
    a, b = edges[:-1], edges[1:]
    b = np.where(buf[b - 1] == 10, b - 1, b) if len(b) else b
    solid = np.searchsorted(start, b) > np.searchsorted(start, a)
    a, b = a[solid], b[solid]
    text = np.searchsorted(off, a, "right") - 1
    line = ww.numbered(buf, a, b)[1]
    lines = np.bincount(text, minlength=n)
    kinds = np.sort(text * (len(line) + 1) + line)
    kinds = kinds[np.append(True, kinds[1:] != kinds[:-1])] if len(kinds) else kinds
    duplicates = lines - np.bincount(kinds // (len(line) + 1), minlength=n)
    # words: numbers for runs of 1, 2, 4 and then 8 words, exact by construction
    owner = ww.owner(first)
    run = ww.numbered(buf, start, end)[1]
    for step in (1, 2, 4):
        run = ww.pairs(run[:-step], run[step:]) if len(run) > step else run[:0]
    repeated = np.zeros(len(start) + 1, np.int64)
    if len(run):
        inside = np.flatnonzero(owner[: len(run)] == owner[7 : 7 + len(run)])
        key = ww.pairs(owner[inside], run[inside])
        twice = inside[np.bincount(key)[key] > 1]
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + 8, -1)
    covered = _per_text(_running(np.cumsum(repeated[:-1]) > 0), first)
    return [np.diff(first), chars, symbols, lines, duplicates, covered]


def with_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` columns of docs and the columns of STATS; null text has none of anything."""
    docs = docs.select(*keep, "text")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")

    @ww.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keep, *(f.split()[0] for f in STATS.split(", "))]
        for batch in batches:
            for a, b, buf, off in ww.blocks(batch.column("text")):
                kept = [batch.column(k).slice(a, b - a) for k in keep]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.int64()) for x in text_stats(buf, off))], names)

    return docs.mapInArrow(task, f"{types}, {STATS}")


def bucket(value: Column) -> Column:
    """The least value of a sketch's bucket: exact to 64, then six leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0)).cast("int")
    return F.when(value < 64, value).otherwise(F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift))


def merged(sketch: DataFrame, wider: DataFrame, by: list[str], shared: list[str]) -> DataFrame:
    """sketch: by, metric, value and n; wider: the same with `shared`, some of `by`, and every value that sketch has. Returns by, metric,
    value and n: a group's counts and the wider ones, scaled to PRIOR documents, over one denominator, so that n is whole."""
    of = lambda names: [F.col(c).alias(f"_{c}") for c in names]
    same = lambda names: functools.reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names))
    wider = wider.withColumn("total", F.sum("n").over(W.partitionBy(*shared, "metric")).cast(WHOLE)).select(*of([*shared, "metric"]), "value", F.col("n").alias("wide"), "total")
    groups = sketch.select(*by, "metric").distinct().join(wider, same([*shared, "metric"])).select(*by, "metric", "value", "wide", "total")
    own = sketch.select(*of([*by, "metric", "value"]), F.col("n").alias("own"))
    n = F.coalesce("own", F.lit(0)).cast(WHOLE) * F.col("total") + F.lit(PRIOR) * F.col("wide")
    return groups.join(own, same([*by, "metric", "value"]), "left").select(*by, "metric", "value", n.cast(WHOLE).alias("n"))


def fences(stats: DataFrame) -> DataFrame:
    """A row per language and source: lang, source and for each metric a lowest and highest value (both inclusive)."""
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), bucket(F.expr(e).cast("long")).alias("value")) for m, (e, *_) in METRICS.items()))
    sketch = stats.filter(~F.col("base_failed")).select("lang", "source", F.explode(cells).alias("c")).groupBy("lang", "source", "c.metric", "c.value").agg(F.count("*").alias("n"))
    sketch = written(sketch.select("lang", "source", "metric", "value", "n"), "sketch")
    every = sketch.groupBy("metric", "value").agg(F.sum("n").cast(WHOLE).alias("n"))
    language = merged(sketch.groupBy("lang", "metric", "value").agg(F.sum("n").alias("n")), every, ["lang"], [])
    group = ["lang", "source", "metric"]
    by_value = W.partitionBy(*group).orderBy("value")
    ranked = merged(sketch, language, ["lang", "source"], ["lang"]).withColumn("upto", F.sum("n").over(by_value)).withColumn("all", F.sum("n").over(W.partitionBy(*group)))
    q = lambda p: F.min(F.when(F.col("upto") * 4 >= F.col("all") * p, F.col("value")))
    groups = ranked.groupBy(*group).agg(F.struct(q(1).alias("q1"), q(3).alias("q3")).alias("q"))
    limits = []
    for m, (_, below, above, least) in METRICS.items():
        mine = F.max(F.when(F.col("metric") == m, F.col("q")))
        spread = F.greatest(mine["q3"] - mine["q1"], F.lit(least))
        limits += [(mine["q1"] - below * spread).alias(f"{m}_low"), (mine["q3"] + above * spread).alias(f"{m}_high")]
    return groups.groupBy("lang", "source").agg(*limits)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, STATS, base_failed and kept, a row per row of docs.

    docs: doc_id, lang, source and text; other columns are ignored. Null text has no words and fails the base rule, as
    does an empty one. A null language or source is a group like any other; rows with equal doc_id are judged each; an
    empty table gives no rows.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = written(with_stats(docs, "doc_id", "lang", "source").withColumn("base_failed", base), "quality-stats")
    limits = fences(stats).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    inside = F.lit(True)
    for m, (e, *_) in METRICS.items():
        value = bucket(F.expr(e).cast("long"))
        inside &= F.coalesce((value >= F.col(f"{m}_low")) & (value <= F.col(f"{m}_high")), F.lit(True))
    joined = stats.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.select("doc_id", *(f.split()[0] for f in STATS.split(", ")), "base_failed", (~F.col("base_failed") & inside).alias("kept"))


def sql() -> str:
    """The same in SQL; windows of words are joined texts there, so it is for small tables."""
    value = lambda e: e.replace(" div ", " // ")
    bucket_ = lambda e: f"(CASE WHEN ({e}) < 64 THEN ({e}) ELSE (({e}) >> (length(bin({e})) - 6)) << (length(bin({e})) - 6) END)"
    metrics = "\n    UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{m}' AS metric, {bucket_(value(e))} AS value FROM b" for m, (e, *_) in METRICS.items())
    fence = "CASE metric " + " ".join(f"WHEN '{m}' THEN value >= q1 - {lo} * greatest(q3 - q1, {least}) AND value <= q3 + {hi} * greatest(q3 - q1, {least})" for m, (_, lo, hi, least) in METRICS.items()) + " END"
    run = " || chr(31) || ".join(f"w[i + {j}]" for j in range(8))
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
g AS (SELECT doc_id, i, {run} AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
tw AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM tw) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS d FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM t) WHERE regexp_matches(x, '{word}') GROUP BY doc_id),
c AS (SELECT t.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(ln.n, 0) AS n_lines, coalesce(ln.d, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words
    FROM t LEFT JOIN ln ON ln.doc_id = t.doc_id LEFT JOIN rw ON rw.doc_id = t.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
v AS ({metrics}),
o AS (SELECT lang, source, metric, value, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
a AS (SELECT *, sum(n) OVER (PARTITION BY metric) AS total FROM (SELECT metric, value, sum(n) AS n FROM o GROUP BY ALL)),
tongues AS (SELECT lang, metric, value, sum(n) AS n FROM o GROUP BY ALL),
l AS (SELECT g.lang, a.metric, a.value, coalesce(t.n, 0) * a.total + {PRIOR} * a.n AS n FROM (SELECT DISTINCT lang FROM o) g CROSS JOIN a
    LEFT JOIN tongues t ON t.lang IS NOT DISTINCT FROM g.lang AND t.metric = a.metric AND t.value = a.value),
lt AS (SELECT *, sum(n) OVER (PARTITION BY lang, metric) AS total FROM l),
m AS (SELECT g.lang, g.source, l.metric, l.value, coalesce(o.n, 0) * l.total + {PRIOR} * l.n AS n FROM (SELECT DISTINCT lang, source FROM o) g JOIN lt l ON l.lang IS NOT DISTINCT FROM g.lang
    LEFT JOIN o ON o.lang IS NOT DISTINCT FROM g.lang AND o.source IS NOT DISTINCT FROM g.source AND o.metric = l.metric AND o.value = l.value),
q AS (SELECT lang, source, metric, min(value) FILTER (WHERE 4 * upto >= total) AS q1, min(value) FILTER (WHERE 4 * upto >= 3 * total) AS q3
    FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY value) AS upto, sum(n) OVER (PARTITION BY lang, source, metric) AS total FROM m) GROUP BY ALL),
f AS (SELECT v.*, q1, q3 FROM v LEFT JOIN q ON q.lang IS NOT DISTINCT FROM v.lang AND q.source IS NOT DISTINCT FROM v.source AND q.metric = v.metric),
k AS (SELECT doc_id, bool_and({fence}) AS fine FROM f GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(fine, true) AS kept FROM b JOIN k ON k.doc_id = b.doc_id
"""
