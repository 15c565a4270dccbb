"""Token ids in binary shards with a minimal perfect hash index from document key to place.

A shard is two files. ``.ids`` holds the ids of its documents one after another, as unsigned 16-bit
little-endian where the vocabulary fits, else 32-bit. ``.idx`` holds a JSON header and these arrays: the sorted keys,
the place of every document's first id (one more than documents), and the index. The index is a cascade of
bit maps: a key that no other key meets in the first map is settled there, the others go on to the next, smaller
one. The rank of a key's bit is its slot, and a slot holds a fingerprint of the key, the number of its first
document and how many documents bear it. So a look-up reads a few words whatever the shard's size; a key that is not
there is told by its fingerprint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import put, scratch, store, written
from tessera.llm.tokens import encoder
from tessera.llm.words import ODD, U64, mix

MANIFEST = "shard int, path string, n_docs long, n_tokens long, first_key long, last_key long"
LEVELS = 24


class KeyIndex:
    """Minimal perfect hash over distinct 64-bit keys: n keys, slots 0 to n - 1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.settled = int(ones.sum())

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys * ODD[level] + U64(level)) % U64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 2.0) -> KeyIndex:
        keys, sizes, maps = keys.astype(np.int64).view(U64), [], []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = 64 * (int(room * len(keys)) // 64 + 1)
            at = cls.place(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            maps.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            keys = keys[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(maps or [np.empty(0, "<u8")]), np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that is not in the index, any slot or -1."""
        keys = keys.astype(np.int64).view(U64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, base) in enumerate(zip(self.sizes.tolist(), self.base.tolist())):
            if not len(open_):
                break
            at = base + self.place(keys[open_], level, size)
            word, bit = self.bits[at >> 6], (at & 63).astype(U64)
            hit = (word >> bit) & U64(1) == 1
            below = np.bitwise_count(word & ((U64(1) << bit) - U64(1)))
            out[open_[hit]] = (self.before[at >> 6] + below)[hit]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            out[open_] = np.where(self.rest[at] == keys[open_], self.settled + at, -1)
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(U64) ^ ODD[99]) >> U64(32)).astype(np.uint32)


class Shard:
    """One written shard, for keyed reads."""

    def __init__(self, path: str):
        files, at = store(path + ".idx")
        with files.open_input_file(at) as f:
            raw = f.read()
        size = int.from_bytes(raw[:4], "little")
        self.header = json.loads(raw[4 : 4 + size])
        self.arrays, at = {}, 4 + size
        for name, kind, n in self.header["arrays"]:
            self.arrays[name] = np.frombuffer(raw, kind, n, at)
            at += self.arrays[name].nbytes
        a = self.arrays
        self.index = KeyIndex(a["sizes"], a["bits"], a["rest"])
        self.files, self.at = store(path + ".ids")

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the first document of each key, -1 if there is none, and how many follow with that key."""
        slot = self.index.slots(keys)
        known = slot >= 0
        known[known] = self.arrays["fingerprint"][slot[known]] == fingerprints(keys[known])
        return np.where(known, self.arrays["first"][slot], -1), np.where(known, self.arrays["count"][slot], 0)

    def ids(self, row: int, n: int = 1) -> np.ndarray:
        """Ids of `n` documents from `row` on."""
        a, b = self.arrays["start"][[row, row + n]].tolist()
        width = np.dtype(self.header["ids"]).itemsize
        with self.files.open_input_file(self.at) as f:
            f.seek(a * width)
            return np.frombuffer(f.read((b - a) * width), self.header["ids"])

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document with this key; none if there is none."""
        row, n = (int(x[0]) for x in self.rows(np.array([key], np.int64)))
        return [self.ids(r) for r in range(row, row + n)] if row >= 0 else []


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encodes every text, appends `end_id` and writes shards in ascending doc_id order; returns the manifest.

    docs: doc_id and text, other columns are ignored. Null text is empty and holds the end id alone. Null keys
    come first; they are in the payload, not in the index. Documents with equal keys stand together, by text.
    An empty table gives an empty manifest. A task writes under temporary names and renames, and a repeated task
    writes the same names with the same content. The manifest is a table, so rows of it stand for complete files.
    """
    folder = folder or scratch(docs.sparkSession, "ids")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        wide = max(encode.tokenizer.get_vocab_size(), end_id + 1) > 65536
        kind, shard = "<u4" if wide else "<u2", TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}"
        keys: list = []
        lengths: list[int] = []
        end = np.array([end_id], kind).tobytes()

        def payload(batch):
            while batch is not None:
                keys.extend(batch.column("doc_id").to_pylist())
                for ids in encode.encode(batch.column("text")):
                    lengths.append(len(ids) + 1)
                    yield ids.astype(kind).tobytes() + end
                batch = next(batches, None)

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        put(path + ".ids", payload(first))
        nulls = keys.count(None)
        known = np.array(keys[nulls:], np.int64)
        distinct, at, count = np.unique(known, return_index=True, return_counts=True)
        index = KeyIndex.build(distinct)
        order = np.argsort(index.slots(distinct))
        arrays = {
            "keys": known, "start": np.concatenate([[0], np.cumsum(lengths)]).astype("<i8"),
            "sizes": index.sizes, "bits": index.bits, "rest": index.rest, "fingerprint": fingerprints(distinct)[order],
            "first": (at + nulls)[order].astype("<i8"), "count": count[order].astype("<i4"),
        }
        header = {"ids": kind, "nulls": nulls, "arrays": [(k, v.dtype.str, len(v)) for k, v in arrays.items()]}
        head = json.dumps(header).encode()
        put(path + ".idx", [len(head).to_bytes(4, "little"), head, *(v.tobytes() for v in arrays.values())])
        row = shard, path, len(lengths), sum(lengths), int(known[0]) if len(known) else None, int(known[-1]) if len(known) else None
        names = [f.split()[0] for f in MANIFEST.split(", ")]
        types = [pa.int32(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

    placed = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(placed.mapInArrow(task, MANIFEST), "ids-manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids of all documents before it) and ids (binary, unsigned 32-bit).

    Each key is looked up in its shard's index; the documents without a key are read in their order.
    """
    before = F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    n = max(1, manifest.count())
    shards = manifest.select("shard", "path", F.coalesce(before, F.lit(0)).cast("long").alias("base"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                shard = Shard(path)
                start, nulls = shard.arrays["start"], shard.header["nulls"]
                keys = shard.arrays["keys"]
                first, _ = shard.rows(keys)
                same = np.concatenate([[False], keys[1:] == keys[:-1]]) if len(keys) else np.empty(0, bool)
                run = np.arange(len(keys)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(keys)))) if len(keys) else 0
                rows = np.concatenate([np.arange(nulls), first + run]).astype(np.int64)
                ids = [None] * nulls + keys.tolist()
                for a in range(0, len(rows), 512):
                    part = rows[a : a + 512]
                    # in key order the rows of a part follow one another, so one read has them all
                    low, high = int(part.min()), int(part.max()) + 1
                    data, zero = shard.ids(low, high - low).astype("<u4"), int(start[low])
                    cells = [data[start[r] - zero : start[r + 1] - zero].tobytes() for r in part.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[a : a + 512], pa.int64()), pa.array(base + start[part], pa.int64()), pa.array(cells, pa.binary())],
                        ["doc_id", "start", "ids"],
                    )

    return shards.repartition(n, "shard").mapInArrow(task, "doc_id long, start long, ids binary")
