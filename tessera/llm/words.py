"""Words and rolling hashes of many texts at once, on the bytes of an Arrow column.

A block is a run of texts laid end to end: ``buf`` holds their UTF-8 bytes and text
i is ``buf[off[i]:off[i + 1]]``. Blocks are cut so that a text is never divided.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE = _rng.integers(1, 2**64, 256, dtype=U64)
QUICK_BASE = 0x9E6C63D0876A9A6F
ODD = _rng.integers(0, 2**63, 4096, dtype=U64) * U64(2) + U64(1)
#: The prime that hashes are taken by, and two bases drawn at random.
PRIME = 2**61 - 1
BASES = [int(x) for x in _rng.integers(2**60, PRIME - 1, 2)]
LOW29, LOW30, LOW31, LOW32, LOW61 = (U64(2**n - 1) for n in (29, 30, 31, 32, 61))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[tuple[int, int], np.ndarray] = {}


def tidy(task: Callable) -> Callable:
    """A task that gives freed memory back when it ends: workers are used again, and what one stage has freed would count beside the next one's."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            _powers.clear()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & LOW61) + (x >> U64(61))
    x -= (x >= LOW61) * LOW61
    return x


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for values below it."""
    a1, a0, b1, b0 = a >> U64(31), a & LOW31, b >> U64(31), b & LOW31
    cross = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << U64(1)) + (cross >> U64(30)) + ((cross & LOW30) << U64(31)) + a0 * b0)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo the prime."""
    have = _powers.get((base, PRIME), np.ones(1, U64))
    while len(have) < n:
        have = np.concatenate([have, times(have, np.full(len(have), pow(base, len(have), PRIME), U64))])
    _powers[base, PRIME] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all bits; one to one."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xA0761D6478BD642F)
    return x ^ (x >> U64(32))


def prefix(values: np.ndarray, base: int = 0) -> np.ndarray:
    """Running polynomial sums from which `span` takes the hash of any range. values: bytes, or numbers below the prime.

    The hash of a range is a polynomial over it modulo 2 ** 61 - 1 at a base drawn at random, so two different ranges of n
    values share it with a chance of n / 2 ** 61 at most, whatever they hold."""
    out = np.empty(len(values) + 1, U64)
    out[0] = carry = U64(0)
    at_base, small = powers(BASES[base], len(values)), values.dtype == np.uint8
    for i in range(0, len(values), 1 << 16):
        p, part = at_base[i : i + (1 << 16)], values[i : i + (1 << 16)].astype(U64) + U64(1)
        if not small:
            p, part = times(p, _reduced(part)), U64(1)
        low, high = np.cumsum((p & LOW32) * part), np.cumsum((p >> U64(32)) * part)
        sums = out[i + 1 : i + 1 + len(p)]
        sums[:] = _reduced(low + (high >> U64(29)) + ((high & LOW29) << U64(32)) + carry)
        carry = sums[-1]
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
    """Hash of values[start:end], the same wherever they stand."""
    inverse = powers(pow(BASES[base], -1, PRIME), len(sums))
    return mix(times(_reduced(sums[end] + (LOW61 - sums[start])), inverse[start]))


def quick_hashes(buf: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n bytes, modulo 2 ** 64. Texts can be made whose hashes meet, so this only ever chooses what is compared."""
    key = QUICK_BASE, len(buf) + 1
    if key not in _powers:
        for old in [k for k in _powers if k[0] == QUICK_BASE]:
            del _powers[old]
        base, inverse = np.full((2, len(buf) + 1), U64(QUICK_BASE)), U64(pow(QUICK_BASE, -1, 2**64))
        base[1], base[:, 0] = inverse, 1
        _powers[key] = np.cumprod(base, axis=1, dtype=U64)
    up, down = _powers[key]
    sums = np.zeros(len(buf) + 1, U64)
    np.cumsum(BYTE[buf] * up[:-1], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: max(len(sums) - n, 0)])


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether buf[a:a + size] equals buf[b:b + size], range by range."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    mask = ~U64(0) >> (U64(8) * (U64(8) - np.minimum(size, 8).astype(U64)) & U64(63))
    tail = np.maximum(size - 8, 0)
    same = (((eight[a] ^ eight[b]) & mask) == 0) & (((eight[a + tail] ^ eight[b + tail]) & mask) == 0) | (size == 0)
    left = np.flatnonzero(same & (size > 16))
    while len(left):  # those of over 16 bytes, in parts
        n = max(1, int(np.searchsorted(np.cumsum(size[left]), 1 << 18, "right")))
        part, left = left[:n], left[n:]
        length = size[part]
        first = np.cumsum(length) - length
        step = np.arange(first[-1] + length[-1]) - np.repeat(first, length)
        differ = buf[np.repeat(a[part], length) + step] != buf[np.repeat(b[part], length) + step]
        same[part] = np.add.reduceat(differ, first, dtype=np.int64) == 0
    return same


def numbered(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each distinct buf[start:end], and for every range the number of its kind: two have one number if and only if their
    bytes are equal. Ranges are told apart by hash and compared with the first of theirs; those that differ from it are kinds by
    their bytes."""
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    _, one, kind = np.unique(span(prefix(buf), start, end), return_index=True, return_inverse=True)
    size, first = end - start, one[kind]
    same = size == size[first]
    same[same] = same_bytes(buf, start[same], start[first[same]], size[same])
    if not same.all():
        more: dict[bytes, int] = {}
        ones = one.tolist()
        for i in np.flatnonzero(~same).tolist():
            data = buf[start[i] : end[i]].tobytes()
            if data not in more:
                more[data] = len(ones)
                ones.append(i)
            kind[i] = more[data]
        one = np.array(ones)
    return one, kind


def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each distinct pair of numbers below 2 ** 31."""
    return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def blocks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, buf, off) for runs of texts of about `limit` bytes; a longer text is a
    run of its own. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        yield first, end, buf[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of the first word (n + 1 long)."""
    gap = SPACE[buf]
    solid = ~gap
    before, after = np.empty(len(buf), bool), np.empty(len(buf), bool)
    if len(buf):
        before[0] = after[-1] = True
        before[1:], after[:-1] = gap[:-1], gap[1:]
        edge = off[(off > 0) & (off < len(buf))]
        before[edge] = True
        after[edge - 1] = True
    start, end = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    return start, end, np.searchsorted(start, off, "left")


def owner(first: np.ndarray) -> np.ndarray:
    """The text that each item belongs to, from the first item of each text (n + 1 long)."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
