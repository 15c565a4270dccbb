"""Packing token ids into sequences by best-fit decreasing.

A document's ids are cut into full windows while they last; what remains is one shorter piece. Each
partition packs its pieces by itself, longest first, each into the open window with the least room that
still takes it, found in a segment tree over the rooms. That is done for every few million ids, so a task's memory
doesn't grow with its partition. A window that stays emptier than a sixteenth is divided into
sequences of a power of two, which need no padding; so padding hardly depends on how many partitions there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.tokens import encoder
from tessera.llm.words import tidy

#: Ids that are packed together.
TOGETHER = 4 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Windows by the room they have left; a segment tree tells which rooms occur."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = np.zeros(2 * self.leaves, np.int64).tolist()
        self.by_room: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, window: int, room: int) -> None:
        self.by_room[room].append(window)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes the window with the least room of at least `need`: (window, room)."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return self.by_room[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each piece, and the number of windows. Equal lengths keep their order."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = OpenWindows(size), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            found = used, size
            used += 1
        window[i], room = found
        offset[i] = size - room
        if room > n:
            tree.add(found[0], room - n)
    return window, offset, used


def divided(window: np.ndarray, offset: np.ndarray, length: np.ndarray, used: int, size: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Parts (piece, its first id, ids, window, offset) after windows with more than a sixteenth of room are divided, and the number of windows."""
    fill = np.bincount(window, length, used).astype(np.int64)
    bare = fill < size - size // 16
    out = [(int(i), 0, int(length[i]), int(window[i]), int(offset[i])) for i in np.flatnonzero(~bare[window])]
    rest = np.flatnonzero(bare[window])
    rest = rest[np.lexsort((offset[rest], window[rest]))]
    now, target, room, at = -1, -1, 0, 0
    for i in rest.tolist():
        if window[i] != now:  # the first power of two takes the window's own number
            now, target, left = int(window[i]), int(window[i]), int(fill[window[i]])
            room, at = 1 << left.bit_length() - 1, 0
        done = 0
        while done < length[i]:
            if at == room:
                left -= room
                room, at, target, used = 1 << left.bit_length() - 1, 0, used, used + 1
            n = int(min(length[i] - done, room - at))
            out.append((i, done, n, target, at))
            done, at = done + n, at + n
    return out, used


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs: doc_id and text, other columns are ignored. Null text is empty and has the end id alone; rows with
    equal or null doc_id are packed like any others; an empty table gives no rows. A sequence is one
    partition's, and sequence_id holds the partition's number above bit 32, so no exchange of texts is needed
    and a task that runs again gives the same rows.
    """

    @tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence = encoder(tokenizer).encode, TaskContext.get().partitionId() << 32
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        pieces: list[tuple] = []  # key, start, ids of the document, data
        held = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            lengths = np.array([len(p[3]) // 4 for p in pieces], np.int64)
            window, offset, used = best_fit_decreasing(lengths, size)
            parts, used = divided(window, offset, lengths, used, size)
            rows = []
            for i, first, n, w, at in sorted(parts):
                key, start, total, data = pieces[i]
                rows.append((key, start + first, n, zlib.crc32(data[4 * first : 4 * (first + n)]), total, sequence + w, at))
            sequence += used
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 10_000])], names)

        for batch in batches:
            for key, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text"))):
                data = ids.astype("<u4").tobytes() + int(end_id).to_bytes(4, "little")
                n = len(data) // 4
                for at in range(0, n, size):
                    pieces.append((key, at, n, data[4 * at : 4 * (at + size)]))
                held += n
                if held >= TOGETHER:
                    yield from packed()
                    pieces, held = [], 0
        if pieces:
            yield from packed()

    return docs.select("doc_id", "text").mapInArrow(task, SCHEMA)
