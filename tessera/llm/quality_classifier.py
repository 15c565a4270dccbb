"""Quality of a text by a byte-level convolutional network in numpy.

A byte comes with a mark if the `GRAM` bytes from it on occurred up to `BACK` bytes before in the same text, and each byte with or
without the mark becomes a short learned vector. Learned filters look at chunks of `WIDTH` bytes, each `STEP` behind the one before and so
overlapping it, over the whole text; of every filter the highest answer in the text counts, and a weighted sum of these
becomes a probability. A chunk is two halves of `STEP` bytes, so a filter's answers are two products of the same matrix, added
with a shift, and chunks are never copied.

The network learns on the driver from a sample of labelled texts: at most `SAMPLE` of them, those of least hash of doc_id,
none longer than `LONGEST` characters. Everything else runs over whole tables. Same sample, same network.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as ww
from tessera.llm.common import crc_mod

SAMPLE, LONGEST = 4000, 40_000
STEP, WIDTH, DEPTH, FILTERS = 4, 8, 8, 32
GRAM, BACK = 6, 40
EPOCHS, BATCH, RATE = 8, 32, 0.01
#: Bytes whose answers are in memory at once.
SLICE = 512 << 10
#: Documents from this score on are good.
GOOD = 0.3


@dataclass
class Network:
    bytes_: np.ndarray  # 512 x DEPTH: bytes without and with the mark
    filters: np.ndarray  # WIDTH * DEPTH x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # FILTERS
    base: np.ndarray  # 1

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(size=shape).astype(np.float32)
        return cls(draw(512, DEPTH) * 0.5, draw(WIDTH * DEPTH, FILTERS) * 0.15, np.zeros(FILTERS, np.float32), draw(FILTERS) * 0.2, np.zeros(1, np.float32))

    def answers(self, symbols: np.ndarray) -> np.ndarray:
        """Filters' answers to the chunks of padded texts, a row per chunk; the last half has no chunk of its own."""
        half = STEP * DEPTH
        x = np.take(self.bytes_, symbols, axis=0).reshape(-1, half)
        both = x @ np.concatenate([self.filters[:half], self.filters[half:]], 1)
        out = both[:-1, :FILTERS]
        out += both[1:, FILTERS:]
        return out

    def pooled(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The highest answer of each filter in each text."""
        n = len(off) - 1
        size = np.diff(off)
        room = STEP * np.maximum(WIDTH // STEP, -(-size // STEP) + 1)  # one half more than the text takes, so that its end is in a chunk
        at = np.concatenate([[0], np.cumsum(room)])
        out = np.full((n, FILTERS), -np.inf, np.float32)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, "right")) - 1)
            padded = np.zeros(at[j] - at[i], np.uint8)
            for t in range(i, j):
                padded[at[t] - at[i] : at[t] - at[i] + size[t]] = buf[off[t] : off[t + 1]]
            symbols = marked(padded, at[i : j + 1] - at[i])
            if j == i + 1 and len(padded) > SLICE:  # one long text, part by part
                for a in range(0, len(padded) - STEP, SLICE):
                    part = self.answers(symbols[a : a + SLICE + STEP])
                    out[i] = np.maximum(out[i], part.max(0))
            else:
                rows = self.answers(symbols)
                first = (at[i:j] - at[i]) // STEP
                last = np.append(first[1:] - 1, len(rows))  # the chunk over two texts belongs to neither
                cuts = np.stack([first, last], 1).ravel()[:-1]
                out[i:j] = np.maximum.reduceat(rows, cuts, axis=0)[::2]
            i = j
        return np.maximum(out + self.bias, 0)

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        z = self.pooled(buf, off).astype(np.float64) @ self.weights.astype(np.float64) + float(self.base[0])
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def marked(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bytes of padded texts, plus 256 where a gram occurred shortly before in the same text. at: where each begins (n + 1 long)."""
    out, n = padded.astype(np.int16), len(padded) - GRAM + 1
    if n <= 0:
        return out
    word = np.zeros(n, np.uint64)
    for i in range(GRAM):
        word |= padded[i : n + i].astype(np.uint64) << np.uint64(8 * i)
    inside = np.arange(len(padded), dtype=np.int32) - np.repeat(at[:-1], np.diff(at)).astype(np.int32)
    hit = np.zeros(n, bool)
    for d in range(1, min(BACK, n - 1) + 1):
        hit[d:] |= (word[d:] == word[:-d]) & (inside[d:n] >= d)
    ends = (at[1:, None] - np.arange(1, GRAM)).ravel()  # grams that would run into the next text
    hit[ends[(ends >= 0) & (ends < n)]] = False
    hit &= padded[:n] != 0
    out[:n][hit] += 256
    return out


def _pad(text: bytes) -> np.ndarray:
    room = STEP * max(WIDTH // STEP, -(-len(text) // STEP) + 1)
    padded = np.frombuffer(text.ljust(room, b"\0"), np.uint8)
    return marked(padded, np.array([0, room]))


def train(texts: list[bytes], labels: list[int], seed: int = 11) -> Network:
    """Adam on the cross-entropy. Gradients reach a filter through the chunk with its highest answer, and only there."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    if not texts:
        return net
    padded = [_pad(t) for t in texts]
    y = np.array(labels, np.float32)
    share = float(np.clip(y.mean(), 0.01, 0.99))
    net.base[0] = np.log(share / (1 - share))
    params = [net.bytes_, net.filters, net.bias, net.weights, net.base]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        rate = RATE * (1 - epoch / EPOCHS)
        for a in range(0, len(order), BATCH):
            batch = order[a : a + BATCH]
            chunks, top = np.empty((len(batch), FILTERS, WIDTH), np.intp), np.empty((len(batch), FILTERS), np.float32)
            for r, t in enumerate(batch):
                rows = net.answers(padded[t])
                best = rows.argmax(0)
                top[r] = rows[best, np.arange(FILTERS)]
                chunks[r] = padded[t][STEP * best[:, None] + np.arange(WIDTH)]
            h = np.maximum(top + net.bias, 0)
            p = 1 / (1 + np.exp(-(h @ net.weights + net.base[0])))
            d = (p - y[batch]) / len(batch)
            dh = np.outer(d, net.weights) * (h > 0)
            x = net.bytes_[chunks].reshape(len(batch), FILTERS, WIDTH * DEPTH)
            d_filters = np.einsum("rf,rfi->if", dh, x)
            dx = (dh[:, :, None] * net.filters.T[None]).reshape(-1, DEPTH)
            d_bytes = np.zeros_like(net.bytes_)
            np.add.at(d_bytes, chunks.ravel(), dx)
            grads = [d_bytes, d_filters, dh.sum(0), h.T @ d, np.array([d.sum()], np.float32)]
            step += 1
            for p_, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(column, 5) == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """A network from labelled documents that aren't held out. docs: doc_id and text; labels: doc_id and quality. Rows with null
    values teach nothing; without any label the network is untrained."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    picked = known.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(SAMPLE)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # SAMPLE rows at most
    texts = texts.filter(F.col("text").isNotNull() & (F.length("text") <= LONGEST))
    rows = sorted(texts.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "text").limit(SAMPLE).collect(), key=lambda r: (r.doc_id, r.text))
    return train([r.text.encode() for r in rows], [r.quality for r in rows])


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """docs with score (0 to 1, higher: better) of each whole text; null text counts as empty, which has a score like any other. A column
    of that name gives way; an empty table gives no rows."""
    docs = docs.drop("score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    @ww.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in ww.blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(net.score(buf, off))], [*batch.schema.names, "score"])

    return docs.mapInArrow(task, f"{schema}, score double")
