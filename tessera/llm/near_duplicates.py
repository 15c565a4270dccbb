"""Near duplicates by shingle sets: minhash with tensored banding, then links confirmed on full sets.

Two small collections of `BANDS` hashes, each over `ROWS` minhashes, are computed for a set. Table keys are all pairs of one
hash from either collection: BANDS * BANDS tables for 2 * BANDS * ROWS minhashes, where the same tables with hashes of their
own would take BANDS * BANDS * 2 * ROWS. A pair of similarity s shares a table unless it misses a whole collection:
at most 2 * (1 - s ** ROWS) ** BANDS, which is 9e-5 at s = 0.8 and 3e-6 at 0.85.

Equal sets are one class from the start. Classes that share a table are joined to the table's smallest class, not to each other;
what hangs together is a family, so every link that tables can show lies within one. Inside a family, links are confirmed on
full sets without making pairs into rows: a task keeps the classes it has already connected, and compares only across
them. A family of more than `SHINGLES` shingles is too large for one task. Its classes are first compared to one hub each, in
parts, which for a group of copies connects nearly all. Those outside the largest component that this gives, the strays, then meet the
whole family, block by block; two classes that are both in that component need no link. So work grows with the strays times the
family, not with its square, no task's size depends on it, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as ww
from tessera.llm.common import written
from tessera.llm.graph import components

ROWS, BANDS = 3, 14
#: Shingles of a family (or of a block of strays and one of the family) in one task, about.
SHINGLES = 100_000
U64 = ww.U64


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct k-word shingles as sorted 64-bit hashes, one text after another, and where each begins (n + 1
    long). A-Z count as a-z. A text of fewer words has one shingle, all of them; of none, none."""
    start, end, first = ww.words(buf, off)
    word, n = ww.span(ww.prefix(ww.LOWER[buf]), start, end), np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    out, rest = np.empty(at[-1], U64), np.ones(at[-1], bool)
    for i in np.flatnonzero((n > 0) & (n < k)).tolist():
        out[at[i]] = (word[first[i] : first[i + 1]] * ww.ODD[: n[i]]).sum(dtype=U64) ^ ww.ODD[60 + int(n[i])]
        rest[at[i]] = False
    if rest.any():
        windows = len(word) - k + 1
        owner = ww.owner(first)
        run = sum(word[j : windows + j] * ww.ODD[j] for j in range(k))
        out[rest] = run[owner[:windows] == owner[k - 1 :]]
    out = ww.mix(out)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[at[:-1][count > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[at]


def exact_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same sets with a number for each distinct shingle in the place of its hash: two shingles have one number only if their words are
    equal."""
    number: dict[bytes, int] = {}
    word, count = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for _, _, buf, off in ww.blocks(texts):
        buf = ww.LOWER[buf]
        start, end, first = ww.words(buf, off)
        one, kind = ww.numbered(buf, start, end)
        word.append(np.array([number.setdefault(buf[a:b].tobytes(), len(number)) for a, b in zip(start[one].tolist(), end[one].tolist())], np.int64)[kind])
        count.append(np.diff(first))
    word, n = np.concatenate(word), np.concatenate(count)
    first = np.concatenate([[0], np.cumsum(n)])
    run = word
    for j in range(1, k):
        run = ww.pairs(run[: len(word) - j], word[j:])
    owner = ww.owner(first)
    whole = np.flatnonzero(owner[: len(run)] == owner[k - 1 : k - 1 + len(run)])
    short: dict[bytes, int] = {}
    few = np.flatnonzero((n > 0) & (n < k))
    few_code = np.array([short.setdefault(word[first[i] : first[i + 1]].tobytes(), len(short)) for i in few.tolist()], np.int64) + len(word)
    codes = len(word) + len(short) + 1
    both = np.unique(np.concatenate([owner[whole] * codes + run[whole], few * codes + few_code]))
    return both % codes, np.searchsorted(both, np.arange(len(n) + 1) * codes)


def collections(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """2 * BANDS hashes for each set: the first collection, then the second. Sets must not be empty."""
    n = len(at) - 1
    least = np.empty((2 * BANDS * ROWS, n), U64)
    i = 0
    while i < n:  # as much at a time as the processor's cache takes
        j = max(i + 1, int(np.searchsorted(at, at[i] + 32_768, "right")) - 1)
        part, place = sets[at[i] : at[j]], at[i:j] - at[i]
        for f in range(len(least)):
            least[f, i:j] = np.minimum.reduceat(part * ww.ODD[100 + f], place)
        i = j
    out = np.empty((n, 2 * BANDS), U64)
    for b in range(2 * BANDS):
        out[:, b] = ww.mix(sum(ww.mix(least[b * ROWS + r]) * ww.ODD[70 + r] for r in range(ROWS)))
    return out


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, fp1 and fp2 (a fingerprint of the set), left and right (the collections; null without shingles)."""

    @ww.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in ww.blocks(batch.column("text")):
                sets, at = shingle_sets(buf, off, k)
                n = np.diff(at)
                some = np.flatnonzero(n)
                bands, prints = np.zeros((b - a, 2 * BANDS), U64), np.zeros((b - a, 2), U64)
                if len(some):
                    begin = at[:-1][some]
                    bands[some] = collections(sets, np.append(begin, len(sets)))
                    for f in range(2):
                        prints[some, f] = np.add.reduceat(ww.mix(sets * ww.ODD[80 + f]), begin)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(bands[:, s].ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64())) for s in (slice(0, BANDS), slice(BANDS, None))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), *(pa.array(x, pa.int64()) for x in (n, prints[:, 0].copy().view(np.int64), prints[:, 1].copy().view(np.int64))), *lists],
                    ["doc_id", "n_shingles", "fp1", "fp2", "left", "right"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, n_shingles long, fp1 long, fp2 long, left array<long>, right array<long>")


def candidate_edges(classes: DataFrame) -> DataFrame:
    """classes: rep, left, right. Edges (a, b) from each class to the smallest one of a table that it shares, once each. Keys are made only of
    hashes that two classes share in the left collection, and then two of these classes in the right one."""

    def shared(bands: DataFrame, to: str) -> DataFrame:
        often = bands.groupBy("i", "h").agg(F.count("*").alias("n")).filter("n > 1").select("i", "h")
        return bands.join(often, ["i", "h"], "left_semi").groupBy("rep").agg(F.collect_list(F.struct("i", "h")).alias(to))

    lefts = written(shared(classes.select("rep", F.posexplode("left").alias("i", "h")), "lefts"), "left-hashes")
    some = classes.select("rep", "right").join(lefts.select("rep").distinct(), "rep")
    rights = shared(some.select("rep", F.posexplode("right").alias("i", "h")), "rights")
    both = lefts.join(rights, "rep").select("rep", "lefts", F.explode("rights").alias("r"))
    keys = both.select("rep", F.explode(F.transform("lefts", lambda x: F.xxhash64(x["i"], x["h"], "r.i", "r.h"))).alias("key"))
    keys = written(keys, "keys")
    hubs = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("key", "hub")
    return keys.join(hubs, "key").filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()


def link(sets: np.ndarray, at: np.ndarray, percent: int, comp: np.ndarray | None = None, ask: np.ndarray | None = None) -> np.ndarray:
    """For each set the first of those that links of at least `percent` similarity connect it to.

    comp: numbers of sets that are connected already; ask: which sets to compare with all others (all, if none is given)."""
    n = np.diff(at)
    order = np.argsort(n, kind="stable")  # by size, so that sets of fitting size stand together
    code = np.unique(sets, return_inverse=True)[1]
    parts = [code[at[i] : at[i + 1]] for i in order.tolist()]
    flat, size = np.concatenate(parts), n[order]
    place = np.concatenate([[0], np.cumsum(size)])
    comp = np.arange(len(n)) if comp is None else np.unique(comp, return_inverse=True)[1][order]
    every = ask is None
    asked = np.arange(len(n)) if every else np.flatnonzero(ask[order])
    mark = np.zeros(int(code.max()) + 1, bool)
    high = np.searchsorted(size * percent, size * 100, "right")
    low = np.searchsorted(size * 100, size * percent, "left")
    for u in asked.tolist():
        first = u + 1 if every else int(low[u])
        others = np.arange(first, high[u])
        others = others[comp[others] != comp[u]]
        if not len(others):
            continue
        mark[parts[u]] = True
        if 3 * len(others) > high[u] - first:
            whole = flat[place[first] : place[high[u]]]
            common = np.add.reduceat(mark[whole].astype(np.int64), place[first : high[u]] - place[first])[others - first]
        else:
            lengths = size[others]
            common = np.add.reduceat(mark[np.concatenate([parts[v] for v in others.tolist()])].astype(np.int64), np.cumsum(lengths) - lengths)
        mark[parts[u]] = False
        for v in others[100 * common >= percent * (size[u] + size[others] - common)].tolist():
            if comp[v] != comp[u]:
                comp[comp == comp[v]] = comp[u]
    out = np.empty(len(n), np.int64)
    out[order] = comp
    least = np.full(len(n), len(n))
    np.minimum.at(least, out, np.arange(len(n)))
    return least[out]


TASK = ["family", "i", "j", "rep", "comp", "ask"]


def confirmed_edges(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """rows: the columns of TASK and text, a row for each class in a task (family, i, j). Edges (a, b) that connect what links to the asking
    classes connect, beyond what equal `comp` already does."""

    def solve(rows: dict[str, list], texts: list[pa.Array]) -> pa.RecordBatch:
        sets, at = exact_sets(pa.concat_arrays(texts), k)
        ids, ask = np.array(rows["rep"], np.int64), np.array(rows["ask"], bool)
        to = ids[link(sets, at, percent, np.array(rows["comp"], np.int64), None if ask.all() else ask)]
        return pa.RecordBatch.from_arrays([pa.array(ids[ids != to]), pa.array(to[ids != to])], ["a", "b"])

    @ww.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, texts = None, {c: [] for c in TASK[3:]}, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in TASK[:3]], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b > a and (now := tuple(keys[a].tolist())) != key:
                    if len(rows["rep"]) > 1:
                        yield solve(rows, texts)
                    key, rows, texts = now, {c: [] for c in TASK[3:]}, []
                for c in TASK[3:]:
                    rows[c] += batch.column(c).slice(a, b - a).to_pylist()
                texts.append(batch.column("text").slice(a, b - a))
        if len(rows["rep"]) > 1:
            yield solve(rows, texts)

    return rows.select(*TASK, "text").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "rep").mapInArrow(task, "a long, b long")


def with_texts(texts: DataFrame, members: DataFrame) -> DataFrame:
    """members (the columns of TASK) with their texts. texts: rep and text."""
    tasks = members.groupBy("rep").agg(F.collect_list(F.struct(*TASK[:3], *TASK[4:])).alias("tasks"))
    found = texts.select("rep", "text").join(tasks.hint("merge"), "rep")
    return found.select("rep", "text", F.explode("tasks").alias("t")).select("t.family", "t.i", "t.j", "rep", "t.comp", "t.ask", "text")


def _spread(column: str, n: Column | str) -> Column:
    return F.pmod(F.xxhash64(column), n).cast("long")


def _upto(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(n), F.lit(1)) - 1))


def large_family_tasks(texts: DataFrame, members: DataFrame, edges: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """members: family, rep, n_shingles of families too large for a task. Links of classes to one hub each, and the tasks for the strays."""
    share = lambda c: F.ceil(F.coalesce(F.sum(c), F.lit(0)) * 2 / SHINGLES).cast("long")
    hubs = edges.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("hub"))
    star = members.join(hubs, "rep")
    parts = star.groupBy("hub").agg(share("n_shingles").alias("parts"))
    zero, own = F.lit(-1).cast("long").alias("j"), F.col("rep").alias("comp")
    asking = parts.select(F.col("hub").alias("family"), _upto("parts").alias("i"), zero, F.col("hub").alias("rep"), F.col("hub").alias("comp"), F.lit(True).alias("ask"))
    asked = star.join(parts, "hub").select(F.col("hub").alias("family"), _spread("rep", F.greatest("parts", F.lit(1))).alias("i"), zero, "rep", own, F.lit(False).alias("ask"))
    linked = written(confirmed_edges(with_texts(texts, asking.unionByName(asked)), k, percent), "star-links")
    labels = components(linked).select(F.col("node").alias("rep"), "component")
    members = written(members.join(labels, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component"), "large-families")
    sizes = members.groupBy("family", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("family").agg(F.max(F.struct("n", "comp")).alias("m")).select("family", F.col("m.comp").alias("main"))
    members = members.join(main, "family").withColumn("stray", F.col("comp") != F.col("main"))
    blocks = members.groupBy("family").agg(share("n_shingles").alias("blocks"), share(F.when(F.col("stray"), F.col("n_shingles"))).alias("strays"))
    members = members.join(blocks.filter("strays > 0"), "family")
    whole = members.select("family", _upto("strays").alias("i"), _spread("rep", F.greatest("blocks", F.lit(1))).alias("j"), "rep", "comp", F.lit(False).alias("ask"))
    strays = members.filter("stray").select("family", _spread("rep", "strays").alias("i"), _upto("blocks").alias("j"), "rep", "comp", F.lit(True).alias("ask"))
    return linked, whole.unionByName(strays)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row per row of docs.

    docs: doc_id (integer) and text; other columns are ignored. Two documents are linked if 100 * common >= percent * united distinct
    shingles of `words` words. component_id is the smallest doc_id reachable over links, and the document that bears it is kept.
    Null, empty or blank text has no shingles, links with nothing and is kept. Rows with equal doc_id are one document: what
    links one links all. Rows with a null doc_id have a null component, are kept, and link nothing. An empty table gives
    no rows.
    """
    sig = written(signatures(docs, words), "signatures")
    full = sig.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["n_shingles", "fp1", "fp2"]
    classes = full.groupBy(*same).agg(F.min(F.struct("doc_id", "left", "right")).alias("m"))
    classes = written(classes.select(*same, F.col("m.doc_id").alias("rep"), "m.left", "m.right"), "classes")
    of = written(full.select("doc_id", *same).join(classes.select(*same, "rep"), same).select("doc_id", "rep", "n_shingles"), "class-of")
    edges = written(candidate_edges(classes), "candidates")
    families = components(edges)
    member = classes.select("rep", "n_shingles").join(families, F.col("rep") == F.col("node")).select("rep", F.col("component").alias("family"), "n_shingles")
    total = member.groupBy("family").agg(F.sum("n_shingles").alias("total"))
    member = written(member.join(total, "family"), "members")
    # all texts are exchanged once, and at every size: a join that is broadcast while the table is small tells nothing about a large one
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(member.hint("merge"), "rep")
    texts = written(texts.select("family", "rep", "total", "text"), "member-texts")
    zero, large = F.lit(0).cast("long"), F.col("total") > SHINGLES
    rows = texts.filter(~large).select("family", zero.alias("i"), zero.alias("j"), "rep", F.col("rep").alias("comp"), F.lit(True).alias("ask"), "text")
    many, stars = member.filter(large).drop("total"), None
    if not many.isEmpty():
        stars, more = large_family_tasks(texts.filter(large), many, edges, words, percent)
        rows = rows.unionByName(with_texts(texts.filter(large), more))
    linked = written(confirmed_edges(rows, words, percent), "links")
    linked = linked.unionByName(stars) if stars is not None else linked
    repeated = of.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("c")).filter("b <> c")
    edges = linked.unionByName(repeated.selectExpr("c AS a", "b")).unionByName(of.join(repeated, "doc_id").selectExpr("rep AS a", "b"))
    labels = components(edges)
    found = of.join(labels, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep").alias("c"))
    found = found.groupBy("doc_id").agg(F.min("c").alias("c"))
    out = sig.select("doc_id", "n_shingles").join(found, "doc_id", "left").withColumn("component_id", F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def sql(words: int = 5, percent: int = 80) -> str:
    """The same in SQL, by joining shingles; for small tables."""
    run = " || chr(31) || ".join(f"w[i + {j}]" for j in range(words))
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {words} THEN array_to_string(w, chr(31)) ELSE {run} END AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {percent} * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS node, x AS seen FROM e UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen),
m AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component, d.doc_id) AS component_id, coalesce(m.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.node = d.doc_id
"""
