"""Token ids by a public tokenizer file, with a cache of text units.

Encoding a text is the same as encoding, one after another, units that the tokenizer
never looks across: a run of ASCII white space with what follows it up to the next one,
cut once more where leading letters or digits meet ASCII punctuation. Distinct units are few: those of a block of
texts are told apart by their bytes, looked up by them in a cache, and the
ids of the block are put together from theirs. A text in which units aren't certain to be
independent (other white space, a special token's name) is encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tessera.llm import words as ww

#: Units in each of a worker's two generations: the younger takes what is looked up, and
#: replaces the older when full, so that frequent units stay.
CACHE = 300_000
#: Bytes of text that are looked up together.
BLOCK = 2 << 20
#: White space other than ASCII's, in UTF-8.
OTHER_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
RARE = np.isin(np.arange(256), [*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, ord("<")])
DIGIT_OR_LETTER = np.zeros(256, bool)
DIGIT_OR_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[33:127] = ~DIGIT_OR_LETTER[33:127]


def units(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each unit, and for each text the number of its first unit (n + 1 long)."""
    start, end, _ = ww.words(buf, off)
    # plain: ASCII letters and digits, and Latin-1 letters (C3 80 to C3 BF but for the signs of multiplication and division)
    plain = DIGIT_OR_LETTER[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
    plain[lead] = plain[lead + 1] = True
    other = np.append(np.flatnonzero(~plain), len(buf))
    first = other[np.searchsorted(other, start)]
    cut = first[(first > start) & (first < end) & PUNCTUATION[buf[np.minimum(first, len(buf) - 1)]]]
    stop = np.zeros(len(buf) + 1, bool)
    stop[end] = stop[cut] = stop[off] = True
    ends = np.flatnonzero(stop[1:]) + 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    return starts, ends, np.searchsorted(starts, off, "left")


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, as unsigned 32-bit; of a null, none."""
        for _, _, buf, off in ww.blocks(texts, BLOCK):
            ids, at = self._block(buf, off)
            alone = self._alone(buf, off)
            for i in range(len(off) - 1):
                if i in alone:
                    yield np.array(self.whole([buf[off[i] : off[i + 1]].tobytes().decode()])[0], np.uint32)
                else:
                    yield ids[at[i] : at[i + 1]]

    def _alone(self, buf: np.ndarray, off: np.ndarray) -> set[int]:
        """Texts that must be encoded whole."""
        rare = np.searchsorted(off, np.flatnonzero(RARE[buf]), "right") - 1
        out = set()
        for i in np.unique(rare).tolist():
            text = buf[off[i] : off[i + 1]].tobytes()
            if OTHER_SPACE.search(text) or any(s in text for s in self.special):
                out.add(i)
        return out

    def _block(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and where each text's begin (n + 1 long)."""
        start, end, first = units(buf, off)
        if not len(start):
            return np.empty(0, np.uint32), np.zeros(len(off), np.int64)
        one, same = ww.numbered(buf, start, end)
        raw = buf.tobytes()
        found = self._find([raw[a:b] for a, b in zip(start[one].tolist(), end[one].tolist())])
        size = np.array([len(x) for x in found], np.int64) // 4
        pool = np.frombuffer(b"".join(found), np.uint32)
        place = np.cumsum(size) - size
        n = size[same]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(place[same] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, upto[first]

    def _find(self, keys: list[bytes]) -> list[bytes]:
        cache = self.cache
        found = [cache.get(k) for k in keys]
        absent = [i for i, x in enumerate(found) if x is None]
        if absent and len(cache) + len(absent) > CACHE:
            self.older, self.cache = cache, (cache := {})
            cache.update((k, x) for k, x in zip(keys, found) if x is not None)
        older, new = self.older, []
        for i in absent:
            x = found[i] = older.get(keys[i])
            if x is None:
                new.append(i)
            else:
                cache[keys[i]] = x
        for j in range(0, len(new), 20_000):
            part = new[j : j + 20_000]
            for i, ids in zip(part, self.whole([keys[i].decode("utf-8", "replace") for i in part])):
                cache[keys[i]] = found[i] = np.array(ids, np.uint32).tobytes()
        return found


_open: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and file."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
