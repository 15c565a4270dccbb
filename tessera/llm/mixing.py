"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Sources share the words of the mix by weight. A source whose share would pass `max_epochs` times its own size
stops there, and what it leaves is shared by weight among the others, until none passes. As the stopped ones are those with
the least cap for their weight, running sums over the sources in that order find them at once.

A source's target is met to the word: every document is taken whole as often as the target holds the source, and
once more while words remain, in a seeded order of documents; the last of these gives its leading words. That order's running
sum is taken in two steps: over 4096 ranges of the hash for each source, then within a range. So no source is one task,
however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORD, unused


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """sizes: source, source_size. Adds target (double) and want (its whole words). Weights repeat over the sources in code point
    order, null last. One row per source, so the windows over all of them hold few rows."""
    n = len(weights)
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % n + 1).cast("int"))
    caps = sizes.withColumns({"weight": weight.cast("long"), "cap": F.col("source_size") * max_epochs})
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    open_ = caps.withColumns(
        {
            "rest": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "open": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)),
        }
    ).withColumn("stopped", F.col("cap").cast("double") * F.col("open") <= F.col("rest").cast("double") * F.col("weight"))
    left = F.sum("source_size").over(everything) - F.sum(F.when(F.col("stopped"), F.col("cap")).otherwise(0)).over(everything)
    among = F.sum(F.when(F.col("stopped"), 0).otherwise(F.col("weight"))).over(everything)
    share = left.cast("double") * F.col("weight") / F.nullif(among, F.lit(0))
    cap = F.col("cap").cast("double")
    return (
        open_.withColumn("target", F.when(F.col("stopped"), cap).otherwise(F.least(cap, share)))
        .withColumn("want", F.floor("target").cast("long"))
        .select("source", "source_size", "target", "want")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 7, size: str | None = None) -> DataFrame:
    """docs with size, source_size, target, copies (whole repetitions), part (words of one more) and taken.

    docs: doc_id, source and text, or a `size` column in its place; other columns are kept, those of the names above
    give way. Null or empty text has size 0 and is taken 0 words. Rows with equal doc_id and size are alike, so it does not
    matter which of them gives the last words. A null source is a source. An empty table gives no rows.
    """
    names = ("source_size", "target", "copies", "part", "taken")
    docs = docs.drop(*names).withColumn("size", F.col(size).cast("long") if size else n_words("text"))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    h, b, n, before, s, r, t, inside, want_ = unused(docs, "_h", "_b", "_n", "_before", "_s", "_r", "_t", "_in", "want")
    docs = docs.withColumns({h: F.substring(key, 1, 16), b: F.substring(key, 1, 3)})
    ranges = docs.groupBy("source", b).agg(F.sum("size").alias(n))
    want = targets(ranges.groupBy("source").agg(F.sum(n).alias("source_size")), weights, max_epochs).withColumnRenamed("want", want_)
    earlier = F.sum(n).over(W.partitionBy("source").orderBy(b).rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.withColumn(before, F.coalesce(earlier, F.lit(0))).select(F.col("source").alias(s), F.col(b).alias(r), before)
    want = want.withColumnRenamed("source", t)
    ranges = ranges.join(want, F.col(s).eqNullSafe(F.col(t)))
    within = W.partitionBy("source", b).orderBy(h, "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    docs = docs.withColumn(inside, F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = docs.join(ranges, F.col("source").eqNullSafe(F.col(s)) & (F.col(b) == F.col(r)))
    whole = F.coalesce(F.floor(F.col(want_) / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    room = F.col(want_) - F.col("copies") * F.col("source_size") - F.col(before) - F.col(inside)
    return (
        out.withColumn("copies", whole)
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), room)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))
        .drop(h, b, s, r, t, before, inside, want_)
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row per whole repetition, and one with the leading words where a part is taken."""
    whole = F.when(F.col("part") == F.col("size"), F.col("copies") + 1).otherwise(F.col("copies"))
    partly = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    lead = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), F.lit(1), F.col("part").cast("int")), " ")
    texts = F.concat(
        F.when(whole > 0, F.array_repeat("text", whole.cast("int"))).otherwise(F.array().cast("array<string>")),
        F.when(partly, F.array(lead)).otherwise(F.array().cast("array<string>")),
    )
    (name,) = unused(mixed, "_texts")
    return mixed.withColumn(name, texts).withColumn("text", F.explode(name)).drop(name)


SQL = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7')[1:16] AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total,
    sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM r),
p AS (SELECT *, CAST(cap AS DOUBLE) * open <= CAST(rest AS DOUBLE) * weight AS stopped FROM o),
t AS (SELECT source, source_size, CASE WHEN stopped THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE),
    CAST(total - sum(CASE WHEN stopped THEN cap ELSE 0 END) OVER () AS DOUBLE) * weight / nullif(sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER (), 0)) END AS target FROM p),
w AS (SELECT *, CAST(floor(target) AS BIGINT) AS want, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) // source_size END AS copies FROM t),
c AS (SELECT d.doc_id, d.size, w.source_size, w.target, w.copies, w.want,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target,
    CAST(copies * size + greatest(0, least(size, want - copies * source_size - before)) AS BIGINT) AS taken FROM c
"""
