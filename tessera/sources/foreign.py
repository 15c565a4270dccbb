"""Headers of formats that are recognised but decoded elsewhere: what a file holds, and whether it can be taken over without loss.

A file is fit if its pixels are 8-bit samples that its format stores without loss, in one still image. Every check reads a few fields and
nothing beyond the file's end; a file that breaks off, or whose fields contradict each other, is invalid.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.files import sniffed

CHECKED = "path string, format string, fit boolean, reason string, width long, height long, frames int, delays array<int>"
#: Directories that a TIFF may chain, and boxes that may lie in each other.
DIRECTORIES, DEPTH = 4096, 8


class Unfit(Exception):
    """A file that is whole but can't be taken over, with the reason."""


class Bits:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes):
        self.value, self.left, self.at = int.from_bytes(data[:4096], "little"), 8 * min(len(data), 4096), 0

    def take(self, n: int) -> int:
        if self.at + n > self.left:
            raise ValueError("the header breaks off")
        out = self.value >> self.at & (1 << n) - 1
        self.at += n
        return out

    def choice(self, *options: tuple[int, int]) -> int:
        """A number by two bits that tell its base and how many bits are added."""
        base, n = options[self.take(2)]
        return base + self.take(n)


def _need(data: bytes, upto: int) -> None:
    if upto > len(data):
        raise ValueError("the file breaks off")


def webp(data: bytes) -> dict:
    """RIFF chunks; only a single lossless stream is fit."""
    _need(data, 20)
    end = min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
    at, found = 12, {}
    while at + 8 <= end:
        kind, size = struct.unpack_from("<4sI", data, at)
        _need(data, at + 8 + size)
        if kind in (b"ANIM", b"ANMF") or (kind == b"VP8X" and size and data[at + 8] & 2):
            raise Unfit("animated")
        if kind == b"VP8 ":
            raise Unfit("lossy")
        if kind == b"VP8L":
            if size < 5 or data[at + 8] != 0x2F:
                raise ValueError("a lossless stream has another mark")
            packed = int.from_bytes(data[at + 9 : at + 13], "little")
            found = {"width": 1 + (packed & 16383), "height": 1 + (packed >> 14 & 16383)}
        at += 8 + size + size % 2
    if not found:
        raise ValueError("there is no image")
    return found


def _boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, first byte and end of the boxes between two places."""
    while at < end:
        if at + 8 > end:
            raise ValueError("a box breaks off")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            _need(data, at + 16)
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        stop = end if size == 0 else at + size
        if size and size < head or stop > end:
            raise ValueError("a box has another size")
        yield kind, at + head, stop
        at = stop


def _jxl_size(bits: Bits) -> tuple[int, int]:
    eighths = bits.take(1)
    side = lambda: 8 * (1 + bits.take(5)) if eighths else bits.choice((1, 9), (1, 13), (1, 18), (1, 30))
    height = side()
    # fixed values: ratios of width to height by number
    ratios = {1: (1, 1), 2: (12, 10), 3: (4, 3), 4: (3, 2), 5: (16, 9), 6: (5, 4), 7: (2, 1)}
    ratio = bits.take(3)
    return (side() if not ratio else height * ratios[ratio][0] // ratios[ratio][1]), height


def _jxl_depth(bits: Bits) -> None:
    if bits.take(1):
        raise Unfit("samples with fractions")
    if bits.choice((8, 0), (10, 0), (12, 0), (1, 6)) > 8:
        raise Unfit("over 8 bits")


def jxl(data: bytes) -> dict:
    """The codestream's size and metadata; a container's boxes are put together first."""
    if data[:2] != b"\xff\x0a":
        parts = [data[a + (4 if kind == b"jxlp" else 0) : b] for kind, a, b in _boxes(data, 0, len(data)) if kind in (b"jxlc", b"jxlp")]
        data = b"".join(parts)
        if data[:2] != b"\xff\x0a":
            raise ValueError("there is no codestream")
    bits = Bits(data[2:])
    width, height = _jxl_size(bits)
    if bits.take(1):
        raise Unfit("samples in a perceptual space")  # what metadata by default say
    if bits.take(1):
        bits.take(3)
        if bits.take(1):
            _jxl_size(bits)
        if bits.take(1):
            raise Unfit("a preview")
        if bits.take(1):
            raise Unfit("animated")
    _jxl_depth(bits)
    bits.take(1)
    for _ in range(bits.choice((0, 0), (1, 0), (2, 4), (1, 12))):
        if bits.take(1):
            continue  # straight alpha of 8 bits
        kind = bits.choice((0, 0), (1, 0), (2, 4), (18, 6))
        _jxl_depth(bits)
        bits.choice((0, 0), (3, 0), (4, 0), (1, 3))
        bits.take(8 * bits.choice((0, 0), (0, 4), (16, 5), (48, 10)))
        if kind:
            raise Unfit("a channel that isn't colour or alpha")
        if bits.take(1):
            raise Unfit("premultiplied alpha")
    if bits.take(1):
        raise Unfit("samples in a perceptual space")
    return {"width": width, "height": height}


def avif(data: bytes) -> dict:
    """Item properties at any depth: size, depth, subsampling, matrix and range."""
    found: dict[str, int] = {}

    def walk(at: int, end: int, depth: int) -> None:
        for kind, a, b in _boxes(data, at, end):
            if kind in (b"moov", b"moof"):
                raise Unfit("animated")
            if kind in (b"meta", b"iprp", b"ipco"):
                if depth == DEPTH:
                    raise ValueError("boxes lie too deep")
                walk(a + (4 if kind == b"meta" else 0), b, depth + 1)
            elif kind == b"ispe":
                _need(data[:b], a + 12)
                width, height = struct.unpack_from(">II", data, a + 4)
                found["width"], found["height"] = max(width, found.get("width", 0)), max(height, found.get("height", 0))
            elif kind == b"av1C":
                _need(data[:b], a + 4)
                if data[a + 2] & 0x40:
                    raise Unfit("over 8 bits")
                if not data[a + 2] & 0x10 and data[a + 2] & 0x0C:
                    raise Unfit("chroma of fewer samples")
                found["coded"] = 1
            elif kind == b"pixi":
                _need(data[:b], a + 5)
                if any(n > 8 for n in data[a + 5 : a + 5 + data[a + 4]]):
                    raise Unfit("over 8 bits")
            elif kind == b"colr" and data[a : a + 4] == b"nclx":
                _need(data[:b], a + 11)
                if struct.unpack_from(">H", data, a + 8)[0]:
                    raise Unfit("a matrix other than identity")
                if not data[a + 10] & 0x80:
                    raise Unfit("a limited range")
                found["colour"] = 1

    walk(0, len(data), 0)
    if "coded" not in found or "width" not in found:
        raise ValueError("there is no image")
    if "colour" not in found:
        raise Unfit("a matrix other than identity")
    return {"width": found["width"], "height": found["height"]}


def tiff(data: bytes) -> dict:
    """Directories, classic or large; fit is one image of whole samples of up to 8 bits, not compressed with loss."""
    _need(data, 8)
    order = "<" if data[:2] == b"II" else ">"
    large = struct.unpack_from(f"{order}H", data, 2)[0] == 43
    if large:
        _need(data, 16)
        if struct.unpack_from(f"{order}HH", data, 4) != (8, 0):
            raise ValueError("a large file's header is invalid")
    place, count_of, entry = ("Q", "Q", 20) if large else ("I", "H", 12)
    word, count_size = struct.calcsize(f"={place}"), struct.calcsize(f"={count_of}")
    at, images, seen = struct.unpack_from(f"{order}{place}", data, 8 if large else 4)[0], 0, set()
    tags: dict[int, list[int]] = {}
    sizes = {1: "B", 3: "H", 4: "I", 16: "Q"}  # fixed values: types of whole numbers
    while at:
        if at in seen or len(seen) == DIRECTORIES:
            raise ValueError("directories have no end")
        seen.add(at)
        _need(data, at + count_size)
        n = struct.unpack_from(f"{order}{count_of}", data, at)[0]
        first = at + count_size
        _need(data, first + n * entry + word)
        here: dict[int, list[int]] = {}
        for i in range(n):
            p = first + i * entry
            tag, kind, many = struct.unpack_from(f"{order}HH{place}", data, p)
            if kind in sizes and tag in (254, 256, 257, 258, 259, 339) and many <= 16:
                width = struct.calcsize(f"={sizes[kind]}") * many
                value = p + 4 + word if width <= word else struct.unpack_from(f"{order}{place}", data, p + 4 + word)[0]
                _need(data, value + width)
                here[tag] = list(struct.unpack_from(f"{order}{many}{sizes[kind]}", data, value))
        if not here.get(254, [0])[0] & 1:  # not a smaller copy
            images += 1
            tags = tags or here
        at = struct.unpack_from(f"{order}{place}", data, first + n * entry)[0]
    if images > 1:
        raise Unfit("several images")
    if not (tags.get(256) and tags.get(257)):
        raise ValueError("there is no image")
    if tags.get(259, [1])[0] in (6, 7, 34892):
        raise Unfit("lossy")
    if max(tags.get(258, [1])) > 8:
        raise Unfit("over 8 bits")
    if any(k != 1 for k in tags.get(339, [1])):
        raise Unfit("samples with a sign or fractions")
    return {"width": tags[256][0], "height": tags[257][0]}


def gif(data: bytes) -> dict:
    """Frames and their delays in milliseconds; a delay of 0 lasts 100. Sequences are fit: they become frames."""
    _need(data, 13)
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at = 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    delays, delay = [], 0

    def skipped(at: int) -> int:
        while True:
            _need(data, at + 1)
            if not data[at]:
                return at + 1
            at += 1 + data[at]

    while True:
        _need(data, at + 1)
        if data[at] == 0x3B:
            break
        if data[at] == 0x21:
            _need(data, at + 8)
            if data[at + 1] == 0xF9 and data[at + 2] == 4:
                delay = 10 * struct.unpack_from("<H", data, at + 4)[0]
            at = skipped(at + 2)
        elif data[at] == 0x2C:
            _need(data, at + 11)
            local = data[at + 9]
            delays.append(delay or 100)
            delay, at = 0, skipped(at + 11 + (3 << (local & 7) + 1 if local & 128 else 0))
        else:
            raise ValueError("an unknown block")
    if not delays:
        raise ValueError("there is no image")
    return {"width": width, "height": height, "frames": len(delays), "delays": delays}


CHECKS = {"webp": webp, "jxl": jxl, "avif": avif, "tiff": tiff, "gif": gif}


def checked(files: DataFrame) -> DataFrame:
    """A row for each file of these formats: the columns of CHECKED. files: path and content. reason is null for a fit file, and says of
    another why it isn't; null content counts as empty and is of no format. Files of other formats have no row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, kind, data in zip(*(batch.column(c).to_pylist() for c in ("path", "format", "content"))):
                found, reason = {}, None
                try:
                    found = CHECKS[kind](data)
                except Unfit as why:
                    reason = str(why)
                except (ValueError, struct.error, IndexError) as why:
                    reason = f"invalid: {why}"
                rows.append((path, kind, reason is None, reason, found.get("width"), found.get("height"), found.get("frames", 1 if found else None), found.get("delays")))
            types = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], [f.split()[0] for f in CHECKED.split(", ")])

    told = files.select("path", sniffed().alias("format"), "content").filter(F.col("format").isin(*CHECKS))
    return told.mapInArrow(task, CHECKED)
