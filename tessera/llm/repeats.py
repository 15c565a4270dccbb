"""Removal of repeated strings: suffixes ordered through `width` bytes by most-significant-digit passes.

Only suffixes that begin a string of `width` bytes inside one text take part. They are ordered through `width`
bytes and no further; a group of equal ones is a repeated string, and a group of one drops out in the pass that
leaves it alone.

The first digit is chosen so that few rows need to move. Of a string's `GRAM`-byte grams it is the one of least hash:
neighbouring strings mostly have it in common, so a run of them, held as one range of a text, is one row of a few numbers.
Rows are counted by that digit, and those whose digit occurs once are done. Of the others, ranges that are equal in full, by a
cryptographic digest of 128 bits, are repeated as they stand. Only ranges that share their first digit but differ, one of each kind,
have their bytes moved to a task, where passes over the next digits, ever wider, order the strings in them; the last step compares bytes.
A first digit with more than `HOT` kinds of ranges isn't put into one task: its strings become rows, counted by two independent
hashes over all their bytes, each modulo 2 ** 61 - 1.

Where a number of words is asked for too, passages of so many words go through the same steps as strings do, with words in the place of
bytes; white space between them doesn't count. In a task, words and then passages are numbered by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as ww
from tessera.llm.common import unused, written

GRAM = 100
#: The same in words.
WORD_GRAM = 8
#: Keeps the first digits of passages apart from those of strings.
SALT = ww.ODD[300]
#: Strings in a range, at most.
RANGE = 2048
#: Bytes of a long text taken at a time, and of ranges ordered at a time.
SEGMENT = 1 << 20
HOT = 8192
U64 = ww.U64


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    done = 1
    while 2 * done <= n:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (n - done)], x[n - done :]) if done < n else x


def word_sums(buf: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
    """Running sums over words, as `prefix` has them over bytes."""
    return ww.prefix(ww.span(ww.prefix(buf, base), start, end, base) % U64(ww.PRIME), base)


def word_grams(buf: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words."""
    at = np.arange(max(len(start) - n + 1, 0))
    return ww.span(word_sums(buf, start, end), at, at + n)


def single_spaced(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with one space after each, and where each begins (n + 1 long)."""
    at = np.concatenate([[0], np.cumsum(end - start + 1)])
    out = np.full(at[-1], 32, np.uint8)
    solid = np.ones(at[-1], bool)
    solid[at[1:] - 1] = False
    out[solid] = buf[np.repeat(start - at[:-1], end - start) + np.flatnonzero(solid)]
    return out, at


def digests(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of digest of each buf[start:end], as two columns."""
    data = memoryview(buf)
    found = b"".join([blake2b(data[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())])
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def ranges(grams: np.ndarray, off: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of strings with the same first digit: text, start in the block, strings, first digit, and whether the digit's gram occurs
    twice in the range (so that strings in it may be equal). grams: a hash of every `gram` bytes, or words."""
    if len(grams) - 1 + gram < width:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, U64, bool))
    least = _sliding_min(grams, width - gram + 1)
    inside = np.zeros(len(least) + 1, np.int8)
    long_ = np.flatnonzero(np.diff(off) >= width)
    inside[off[long_]] = 1
    inside[off[long_ + 1] - width + 1] -= 1
    at = np.flatnonzero(np.cumsum(inside[:-1]))
    value = least[at]
    text = np.searchsorted(off, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(at)))
    pieces = -(-size // RANGE)
    head = np.repeat(head, pieces) + RANGE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    size = np.minimum(np.diff(np.append(head, len(at))), RANGE)
    start, value, text = at[head], value[head], text[head]
    # grams that are some range's digit, by digit and place
    kinds, rank = np.unique(value, return_inverse=True)
    table = np.zeros(1 << 22, bool)
    table[kinds & U64((1 << 22) - 1)] = True
    where = np.flatnonzero(table[grams & U64((1 << 22) - 1)])
    kind = np.minimum(np.searchsorted(kinds, grams[where]), max(len(kinds) - 1, 0))
    same = kinds[kind] == grams[where] if len(kinds) else np.empty(0, bool)
    places = np.sort((kind[same] << 40) + where[same])
    first = (rank << 40) + start
    twice = np.searchsorted(places, first + size + width - gram) - np.searchsorted(places, first) > 1
    return text, start, size, value, twice


def all_ranges(docs: DataFrame, width: int, words: int = 0) -> DataFrame:
    """docs: doc_id, key, text. A row per range: doc_id, key, start and size in bytes, n, a (first digit), c and c2 (digest of the range),
    twice, words (whether it is one of passages)."""
    gram, word_gram = min(GRAM, width), min(WORD_GRAM, words)

    def segments(buf: np.ndarray) -> Iterator[int]:
        yield from range(0, max(1, len(buf) - width + 1), SEGMENT)

    def strings(buf: np.ndarray, off: np.ndarray, long_: bool) -> Iterator[tuple]:
        for x in segments(buf) if long_ else [0]:
            piece = buf[x : x + SEGMENT + width - 1] if long_ else buf
            edge = np.array([0, len(piece)]) if long_ else off
            if len(piece) >= width:
                text, start, n, a, twice = ranges(ww.quick_hashes(piece, gram), edge, width, gram)
                size = n + width - 1
                yield text, start - edge[text] + x, size, n, a, digests(piece, start, start + size), twice, False

    def passages(buf: np.ndarray, off: np.ndarray, long_: bool) -> Iterator[tuple]:
        begin, stop, first = ww.words(buf, off)
        for x in range(0, len(begin) - words + 1, SEGMENT // 4 if long_ else max(len(begin), 1)):
            b, e = (v[x : x + SEGMENT // 4 + words - 1] if long_ else v for v in (begin, stop))
            grams = word_grams(buf[b[0] : e[-1]], b - b[0], e - b[0], word_gram)
            text, at, n, a, twice = ranges(grams, np.array([0, len(b)]) if long_ else first, words, word_gram)
            line, place = single_spaced(buf, b, e)
            start, last = b[at], at + n + words - 1
            yield text, start - off[text], e[last - 1] - start, n, a ^ SALT, digests(line, place[at], place[last]), twice, True

    @ww.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, buf, off in ww.blocks(batch.column("text"), SEGMENT):
                for kind in (strings, passages) if words else (strings,):
                    for text, start, size, n, a, c, twice, is_words in kind(buf, off, end == first + 1):
                        if not len(text):
                            continue
                        rows = pa.array(text + first)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(rows), batch.column("key").take(rows), pa.array(start), pa.array(size), pa.array(n.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy()), pa.array(twice), pa.array(np.full(len(text), is_words))],
                            ["doc_id", "key", "start", "size", "n", "a", "c", "c2", "twice", "words"],
                        )

    return docs.mapInArrow(task, "doc_id long, key long, start long, size long, n int, a long, c long, c2 long, twice boolean, words boolean")


def equal_strings(buf: np.ndarray, start: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Which of the strings buf[start:start + width] equal another one of their group."""
    sums, alive, at = ww.prefix(buf), np.arange(len(start)), 0
    digits = [min(d, width) for d in (16, 80)] + [width]
    for upto in digits:
        if upto > at:
            p = start[alive]
            digit = ww.mix(ww.span(sums, p + at, p + upto) ^ (group[alive].astype(U64) * ww.ODD[200]))
            order = np.argsort(digit)
            digit = digit[order]
            new = np.append(True, digit[1:] != digit[:-1])[: len(order)]
            number = np.cumsum(new) - 1
            many = np.bincount(number)[number] > 1 if len(number) else np.empty(0, bool)
            alive, group, at = alive[order[many]], group.copy(), upto
            group[alive] = number[many]
    # by bytes: each group against its first string
    out = np.zeros(len(start), bool)
    if len(alive):
        of = group[alive]
        new = np.append(True, of[1:] != of[:-1])
        one = np.flatnonzero(new)[np.cumsum(new) - 1]
        same = np.ones(len(alive), bool)
        p, q = start[alive], start[alive][one]
        for i in range(0, width - 7, 8):
            same &= _word(buf, p + i) == _word(buf, q + i)
        for i in range(width - width % 8, width):
            same &= buf[p + i] == buf[q + i]
        others = np.add.reduceat(same.astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
        out[alive[same & (others > 1)]] = True
        if not same.all():  # two digits met: those strings are compared among themselves
            rest = alive[~same]
            out[rest] = equal_strings(buf, start[rest], of[~same], width)
    return out


def _word(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes at any place, as one number."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))[at]


def passages_in(buf: np.ndarray, off: np.ndarray, n: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """Of ranges of n passages: range, first word, first and last byte in the block of each passage; and all words' first and last bytes."""
    begin, stop, first = ww.words(buf, off)
    of = np.repeat(np.arange(len(n)), n)
    at = first[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]
    return of, at, begin[at], stop[at + words - 1], begin, stop


def numbered_runs(number: np.ndarray, words: int) -> np.ndarray:
    """A number for every run of so many words, equal if and only if all their numbers are."""
    run, have = number, 1
    while have < words:
        step = min(have, words - have)
        run = ww.pairs(run[:-step], run[step:])
        have += step
    return run


def resolve(kinds: DataFrame, width: int, words: int = 0) -> DataFrame:
    """kinds: a, n, once, doc_id, key, start and bytes, sorted by a. Spans of repeated strings, or passages of `words` words, in the ranges that
    occur once."""

    def solve_words(rows: dict[str, list]) -> pa.RecordBatch:
        off = np.cumsum([0] + [len(b) for b in rows["bytes"]])
        buf = np.frombuffer(b"".join(rows["bytes"]), np.uint8)
        of, at, begin, stop, *every = passages_in(buf, off, np.array(rows["n"], np.int64), words)
        number = numbered_runs(ww.numbered(buf, *every)[1], words)[at]
        hit = (np.bincount(number)[number] > 1) & np.array(rows["once"], bool)[of]
        place, row = np.flatnonzero(hit), of[hit]
        head = np.flatnonzero(np.append(True, (place[1:] != place[:-1] + 1) | (row[1:] != row[:-1]))[: len(place)])
        last = np.append(head[1:], len(place))[: len(head)] - 1
        row = row[head]
        shift = np.array(rows["start"], np.int64)[row] - off[row]
        ids, keys = pa.array(rows["doc_id"], pa.int64()), pa.array(rows["key"], pa.int64())
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), keys.take(pa.array(row)), pa.array(begin[place[head]] + shift), pa.array(stop[place[last]] + shift)], ["doc_id", "key", "start", "end"])

    def solve(rows: dict[str, list]) -> pa.RecordBatch:
        sizes = np.array([len(b) for b in rows["bytes"]], np.int64)
        buf, begin, n = np.frombuffer(b"".join(rows["bytes"]), np.uint8), np.cumsum(sizes) - sizes, np.array(rows["n"], np.int64)
        of = np.repeat(np.arange(len(n)), n)
        start = begin[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]
        hit = equal_strings(buf, start, np.unique(np.array(rows["a"], np.int64), return_inverse=True)[1][of], width)
        hit &= np.array(rows["once"], bool)[of]
        place, of = start[hit], of[hit]
        new = np.append(True, (place[1:] != place[:-1] + 1) | (of[1:] != of[:-1]))[: len(place)]
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(place))[: len(head)] - 1
        row = of[head]
        shift = np.array(rows["start"], np.int64)[row] - begin[row]
        ids, keys = pa.array(rows["doc_id"], pa.int64()), pa.array(rows["key"], pa.int64())
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), keys.take(pa.array(row)), pa.array(place[head] + shift), pa.array(place[last] + shift + width)], ["doc_id", "key", "start", "end"])

    @ww.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "n", "once", "doc_id", "key", "start", "bytes"]
        rows: dict[str, list] = {c: [] for c in names}
        held = 0
        for batch in batches:
            for values in zip(*(batch.column(c).to_pylist() for c in names)):
                if held >= SEGMENT and values[0] != rows["a"][-1]:
                    yield (solve_words if words else solve)(rows)
                    rows, held = {c: [] for c in names}, 0
                for c, v in zip(names, values):
                    rows[c].append(v)
                held += len(values[-1])
        if held:
            yield (solve_words if words else solve)(rows)

    return kinds.select("a", "n", "once", "doc_id", "key", "start", "bytes").mapInArrow(task, "doc_id long, key long, start long, end long")


def _string_rows(width: int, words: int = 0):
    """For ranges under a hot first digit: a row per string or passage, with two hashes of it."""

    @ww.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("n", "once", "doc_id", "key", "start", "words", "bytes")
            for n, once, doc, key, start, is_words, data in zip(*(batch.column(c).to_pylist() for c in names)):
                buf, p = np.frombuffer(data, np.uint8), np.arange(n)
                if is_words:
                    _, at, p, end, *every = passages_in(buf, np.array([0, len(buf)]), np.array([n]), words)
                    hashes = [ww.span(word_sums(buf, *every, b), at, at + words, b) ^ SALT for b in (0, 1)]
                else:
                    hashes, end = [ww.span(ww.prefix(buf, b), p, p + width, b) for b in (0, 1)], p + width
                yield pa.RecordBatch.from_arrays([*(pa.array(h.view(np.int64)) for h in hashes), pa.array([doc] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(p + start), pa.array(end + start), pa.array([once] * n), pa.array([is_words] * n)], ["h1", "h2", "doc_id", "key", "start", "end", "once", "words"])

    return task


def with_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", F.xxhash64("text"))


def repeated_spans(docs: DataFrame, width: int = 400, words: int = 0) -> DataFrame:
    """A row per document with repeated strings: doc_id, key (hash of its text) and spans, an array of (start, end) bytes and whether it is
    one of passages; they may overlap."""
    docs = with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = written(all_ranges(docs, width, words), "ranges")
    often = found.groupBy("a").agg(F.count("*").alias("m"), F.bool_or("twice").alias("t")).filter("m > 1 OR t").select("a")
    often = written(often, "shared-digits")  # a table of its own, so that Spark can split the join at a hot digit
    found = written(found.join(often, "a", "left_semi"), "shared-ranges")
    same = ["a", "c", "c2", "n"]
    kinds = found.groupBy(*same).agg(F.count("*").alias("m"), F.bool_or("twice").alias("twice"), F.min(F.struct("doc_id", "key", "start", "size", "words")).alias("one"))
    kinds = written(kinds, "kinds")
    whole = found.join(kinds.filter("m > 1").select(*same), same, "left_semi").select("doc_id", "key", "start", (F.col("start") + F.col("size")).alias("end"), "words")
    differ = kinds.groupBy("a").agg(F.count("*").alias("kinds"), F.bool_or("twice").alias("inner")).filter("kinds > 1 OR inner")
    differ = written(differ, "differing-digits")
    differ = kinds.join(differ, "a").select("a", "n", (F.col("m") == 1).alias("once"), "kinds", "one.*")
    wanted = differ.groupBy("doc_id", "key").agg(F.collect_list(F.struct("a", "n", "once", "kinds", "start", "size", "words")).alias("wanted"))
    wanted = wanted.withColumnsRenamed({"doc_id": "_d", "key": "_k"})
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))
    one = docs.join(wanted, on).dropDuplicates(["doc_id", "key"]).select("doc_id", "key", F.col("text").cast("binary").alias("text"), F.explode("wanted").alias("w"))
    cut = F.substring(F.col("text"), (F.col("w.start") + 1).cast("int"), F.col("w.size").cast("int"))
    texts = written(one.select("doc_id", "key", "w.*", cut.alias("bytes")), "range-bytes")
    usual = lambda kind: texts.filter((F.col("kinds") <= HOT) & kind).repartition("a").sortWithinPartitions("a", "doc_id", "start")
    spans = whole.unionByName(resolve(usual(~F.col("words")), width).withColumn("words", F.lit(False)))
    if words:
        spans = spans.unionByName(resolve(usual(F.col("words")), width, words).withColumn("words", F.lit(True)))
    hot = texts.filter(F.col("kinds") > HOT)
    if not hot.isEmpty():
        strings = written(hot.select("n", "once", "doc_id", "key", "start", "words", "bytes").mapInArrow(_string_rows(width, words), "h1 long, h2 long, doc_id long, key long, start long, end long, once boolean, words boolean"), "strings")
        twice = strings.groupBy("h1", "h2").agg(F.count("*").alias("m")).filter("m > 1").select("h1", "h2")
        again = strings.filter("once").join(twice, ["h1", "h2"], "left_semi")
        spans = spans.unionByName(again.select("doc_id", "key", "start", "end", "words"))
    return spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end", "words")).alias("spans"))


def remove_repeats(docs: DataFrame, width: int = 400, words: int = 0, cut: bool = True) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (maximal removed runs), n_passage_words and kept (binary, what remains).

    Every byte goes that a string of `width` bytes covers which also starts anywhere else, in the same text or another; strings are judged on
    the texts as they come. docs: doc_id (integer), text and any other columns, which stay but for those of the names above.
    Null text is empty. Rows with equal doc_id are documents of their own, equal rows repeat each other. A text
    shorter than `width` loses nothing. An empty table gives no rows.

    With `words`, passages of so many words that also start anywhere else are found too; words are what white space of ASCII separates.
    n_passage_words counts the words in them (0 without `words`). Their bytes go as well, unless `cut` is false; the space around a
    passage stays.
    """
    new = ("n_bytes", "n_removed", "n_spans", "n_passage_words", "kept")
    docs = docs.drop(*new)
    key, spans_, d, k = unused(docs, "_key", "_spans", "_doc", "_of")
    spans = repeated_spans(docs, width, words).select(F.col("doc_id").alias(d), F.col("key").alias(k), F.col("spans").alias(spans_))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    docs = docs.withColumn(key, F.xxhash64("text"))
    joined = docs.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(key) == F.col(k)), "left").drop(key, d, k)

    def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, end, -1)
        return np.cumsum(change[:-1]) > 0

    @ww.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, buf, off in ww.blocks(batch.column("text"), SEGMENT):
                lists = batch.column(spans_).slice(first, end - first)
                flat, base = lists.flatten(), np.repeat(off[:-1], np.diff(lists.offsets.to_numpy()))
                a, b, of_words = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end", "words"))
                a, b, of_words = a + base, b + base, of_words.astype(bool)
                passages = covered(len(buf), a[of_words], b[of_words])
                out = covered(len(buf), a[~of_words], b[~of_words])
                if cut:
                    out |= passages
                before = np.concatenate([[False], out[:-1]])
                before[off[:-1][off[:-1] < len(buf)]] = False
                total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[off])
                removed, runs, n = total(out), total(out & ~before), np.diff(off)
                if len(flat):
                    begin, _, at = ww.words(buf, off)
                    repeated = np.diff(np.concatenate([[0], np.cumsum(passages[begin])])[at])
                else:
                    repeated = np.zeros(len(n), np.int64)
                left = np.concatenate([[0], np.cumsum(n - removed)])
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(buf[~out].tobytes())])
                names = [c for c in batch.schema.names if c != spans_]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, end - first) for c in names), pa.array(n), pa.array(removed), pa.array(runs), pa.array(repeated), kept.cast(pa.binary())], [*names, *new])

    return joined.mapInArrow(task, f"{schema}, n_bytes long, n_removed long, n_spans long, n_passage_words long, kept binary")


def sql(width: int = 400, words: int = 51) -> str:
    """The same in SQL over hexadecimal digits and joined words, for small tables with distinct doc_id."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, {2 * width})) AS m FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - {width - 1}, 0))) AS i FROM d)),
r AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY m) > 1),
n AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {width} THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM n),
s AS (SELECT doc_id, min(i) AS a, max(i) + {width} AS b FROM g GROUP BY doc_id, g),
k AS (SELECT s.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || max(substring(h, 2 * last + 1)) AS kept
    FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, max(b) OVER (PARTITION BY doc_id) AS last FROM s) s JOIN d ON d.doc_id = s.doc_id GROUP BY s.doc_id),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
wp AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + {words - 1}), ' ')) AS m FROM (SELECT doc_id, w, unnest(range(1, len(w) - {words - 2})) AS i FROM w WHERE len(w) >= {words})),
wr AS (SELECT doc_id, i FROM wp QUALIFY count(*) OVER (PARTITION BY m) > 1),
wk AS (SELECT doc_id, CAST(sum(least(next - i, {words})) AS BIGINT) AS n FROM (SELECT doc_id, i, lead(i, 1, i + {words}) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM wr) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256,
    coalesce(wk.n, 0) AS n_passage_words
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN wk ON wk.doc_id = d.doc_id
"""
