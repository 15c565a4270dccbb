"""Coding of single images and frame sequences: the sequential part, in Python kernels over one record.

A still image becomes a container with the smallest of its candidates; ties go to the one made first. `decode` reads what
`encode` writes and the other layouts of the same families. A damaged or hostile file raises `BadFile`, before any large
buffer is made, and never gives part of an image.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from tessera.operators import native, regions, tile_models
from tessera.operators.native import MAX_PIXELS, BadFile

#: File marker, modes, transforms and frame kinds of the container.
MARK = b"\x51\x4c\x49\x43"
GRAY, GRAYA, RGB, RGBA, PALETTE, SEPARABLE, NATIVE, FILTERED, PSTREAM, PPAL, CPAL, TILES, TILE_MODEL, GMODEL, ANIM, BLOCKS = 1, 2, 3, 4, 5, 7, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18
PLAIN, GDELTA, RAW, GDELTA_RAW, RLE, GDELTA_RLE, RUNS, SEP_DELTA, RDELTA, BDELTA, PAL_DELTA = range(11)
KEY, DUPLICATE, RECTANGLE, MOVE = range(4)
CRC_FLAG = 0x80
MAX_FILE = MAX_PAYLOAD = MAX_ANIMATION = 512 << 20
MAX_FRAMES = 100_000
#: Lines in a tile of its own.
TILE = 1024


@dataclass
class Header:
    width: int
    height: int
    mode: int
    transform: int
    bits: int
    codec: int
    count: int
    payload: int


# ---------------------------------------------------------------- bytes


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise BadFile("a number is cut off")
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if not data[at - 1] & 128:
            return value, at


def runs_of(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Length and value of each run."""
    if not len(values):
        return
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    yield from zip(np.diff(np.append(at, len(values))).tolist(), values[at].tolist())


def rle(values: np.ndarray, wide: bool = False) -> bytes:
    """Run lengths less one, each with its byte, or with a number if `wide`."""
    return b"".join(varint(n - 1) + (varint(v) if wide else bytes([v])) for n, v in runs_of(values))


def unrle(data: bytes, size: int, wide: bool = False) -> np.ndarray:
    lengths, values, at, total = [], [], 0, 0
    while at < len(data):
        n, at = read_varint(data, at)
        if wide:
            v, at = read_varint(data, at)
        elif at < len(data):
            v, at = data[at], at + 1
        else:
            raise BadFile("a run is cut off")
        total += n + 1
        if total > size:
            raise BadFile("runs are too long")
        lengths.append(n + 1)
        values.append(v)
    if total != size:
        raise BadFile("runs are too short")
    return np.repeat(np.array(values, np.int64), lengths)


def pack_lines(ids: np.ndarray, bits: int) -> bytes:
    """Lines of numbers, `bits` each from the lowest bit up, every line filled to a byte."""
    cells = (ids[:, :, None] >> np.arange(bits)) & 1
    return np.packbits(cells.reshape(len(ids), -1).astype(np.uint8), axis=1, bitorder="little").tobytes()


def unpack_lines(data: bytes, width: int, height: int, bits: int) -> np.ndarray:
    line = -(-width * bits // 8)
    if len(data) != line * height:
        raise BadFile("index lines have another size")
    cells = np.unpackbits(np.frombuffer(data, np.uint8).reshape(height, line), axis=1, bitorder="little")[:, : width * bits]
    return (cells.reshape(height, width, bits).astype(np.int64) << np.arange(bits)).sum(2)


def index_bits(n: int) -> int:
    return next((b for b in (1, 2, 4, 8) if n <= 1 << b), max(9, (n - 1).bit_length()))


# ---------------------------------------------------------------- samples and byte filters


def mode_of(rgba: np.ndarray) -> int:
    opaque, gray = (rgba[..., 3] == 255).all(), (rgba[..., 0] == rgba[..., 1]).all() and (rgba[..., 1] == rgba[..., 2]).all()
    return (GRAY if opaque else GRAYA) if gray else (RGB if opaque else RGBA)


def samples(rgba: np.ndarray, mode: int, anchor: int | None = None) -> np.ndarray:
    """Channels of a mode; with an anchor (0 to 2) the other colours as differences to it, in their order."""
    if mode in (GRAY, GRAYA):
        return rgba[..., [0] if mode == GRAY else [0, 3]]
    out = rgba[..., :mode].copy()
    if anchor is not None:
        rest = [c for c in range(3) if c != anchor]
        out[..., 0] = rgba[..., anchor]
        out[..., 1:3] = rgba[..., rest] - rgba[..., [anchor]]
    return out


def unsamples(s: np.ndarray, mode: int, anchor: int | None = None) -> np.ndarray:
    out = np.full((*s.shape[:2], 4), 255, np.uint8)
    if mode in (GRAY, GRAYA):
        out[..., :3] = s[..., :1]
        if mode == GRAYA:
            out[..., 3] = s[..., 1]
        return out
    out[..., :mode] = s
    if anchor is not None:
        rest = [c for c in range(3) if c != anchor]
        out[..., anchor] = s[..., 0]
        out[..., rest] = s[..., 1:3] + s[..., :1]
    return out


def _paeth(a, b, c):
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def _predictions(lines: np.ndarray, step: int) -> list[np.ndarray]:
    """The six byte filters' predictions; 0 outside."""
    v = lines.astype(np.int32)
    left, up, corner = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    left[:, step:], up[1:], corner[1:, step:] = v[:, :-step], v[:-1], v[:-1, :-step]
    return [np.zeros_like(v), left, up, (left + up) >> 1, _paeth(left, up, corner), np.clip(left + up - corner, 0, 255)]


def filter_lines(lines: np.ndarray, step: int) -> bytes:
    """Each line with the filter, of 1, 2 and 5, whose residuals are least in sum, before it."""
    every = _predictions(lines, step)
    rest = np.stack([(lines - every[c]) & 255 for c in (1, 2, 5)])
    pick = np.minimum(rest, 256 - rest).sum(2).argmin(0)
    body = np.take_along_axis(rest, pick[None, :, None], 0)[0]
    return np.concatenate([np.array([1, 2, 5])[pick][:, None], body], 1).astype(np.uint8).tobytes()


def unfilter_lines(data: bytes, line: int, height: int, step: int) -> np.ndarray:
    if len(data) != (line + 1) * height:
        raise BadFile("filtered lines have another size")
    rows = np.frombuffer(data, np.uint8).reshape(height, line + 1)
    out, above = np.zeros((height, line), np.uint8), np.zeros(line, np.int64)
    for y in range(height):
        kind, row = int(rows[y, 0]), rows[y, 1:].astype(np.int64)
        if kind > 5:
            raise BadFile("no such filter")
        if kind == 0:
            now = row
        elif kind == 1:
            now = np.cumsum(np.pad(row, (0, -line % step)).reshape(-1, step), 0).ravel()[:line]
        elif kind == 2:
            now = row + above
        else:
            now = row.copy()
            for x in range(line):
                left, corner = (int(now[x - step]), int(above[x - step])) if x >= step else (0, 0)
                up = int(above[x])
                guess = (left + up) >> 1 if kind == 3 else int(_paeth(left, up, corner)) if kind == 4 else min(255, max(0, left + up - corner))
                now[x] = now[x] + guess & 255
        above = out[y] = now & 255
    return out


# ---------------------------------------------------------------- blocks of 16 by 16


def encode_blocks(rgba: np.ndarray) -> bytes:
    """Block operations by least size; an earlier equal block is referred to by its distance."""
    kind = mode_of(rgba)
    channels = {GRAY: 1, RGB: 3}.get(kind, 4)
    h, w = rgba.shape[:2]
    out, seen, blocks, extended = bytearray(), {}, {}, False
    index, across = 0, -(-w // 16)
    for y in range(0, h, 16):
        for x in range(0, w, 16):
            block = rgba[y : y + 16, x : x + 16, :channels]
            bh, bw = block.shape[:2]
            flat = [bytes(p) for p in block.reshape(-1, channels)]
            key = (bw, bh, block.tobytes())
            blocks[index] = key
            options = [(1 + len(flat) * channels, lambda: bytes([0]) + b"".join(flat))]
            colours = list(dict.fromkeys(flat))
            if len(colours) == 1:
                options.append((1 + channels, lambda: bytes([1]) + flat[0]))
            if x and blocks[index - 1] == key:
                options.append((1, lambda: bytes([2])))
            if y and blocks[index - across] == key:
                options.append((1, lambda: bytes([3])))
            if 2 <= len(colours) <= 4:
                bits = (len(colours) - 1).bit_length()
                ids = pack_lines(np.array([[colours.index(p) for p in flat]]), bits)
                head = bytes([4]) if len(colours) == 2 else bytes([5, len(colours)])
                options.append((len(head) + len(colours) * channels + len(ids), lambda: head + b"".join(colours) + ids))
            pats = [tuple(bytes(block[min(j, bh - 1), min(i, bw - 1)]) for j in (py, py + 1) for i in (px, px + 1)) for py in range(0, bh, 2) for px in range(0, bw, 2)]
            kinds = list(dict.fromkeys(pats))
            if 1 < len(kinds) <= 16:
                pids = pack_lines(np.array([[kinds.index(p) for p in pats]]), (len(kinds) - 1).bit_length())
                options.append((2 + len(kinds) * 4 * channels + len(pids), lambda: bytes([6, len(kinds)]) + b"".join(c for p in kinds for c in p) + pids))
            if key in seen:
                far = varint(index - seen[key])
                options.append((1 + len(far), lambda: bytes([7]) + far))
            best = min(o[0] for o in options)
            made = next(o[1]() for o in options if o[0] == best)
            extended |= made[0] == 7
            out += made
            seen[key] = index
            index += 1
    return (b"QBR1" if extended else b"QBL1") + bytes([16, channels, 0, 0]) + bytes(out)


def decode_blocks(data: bytes, w: int, h: int) -> np.ndarray:
    if len(data) < 8 or data[:4] not in (b"QBL1", b"QBR1") or data[4] != 16 or data[5] not in (1, 3, 4) or data[6:8] != b"\0\0":
        raise BadFile("block layout is not supported")
    channels, at, index, across = data[5], 8, 0, -(-w // 16)
    out = np.full((h, w, 4), 255, np.uint8)

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise BadFile("blocks are cut off")
        at += n
        return data[at - n : at]

    def colours(n: int) -> np.ndarray:
        c = np.frombuffer(take(n * channels), np.uint8).reshape(n, channels)
        return np.repeat(c, 3, 1) if channels == 1 else c

    def ids(n: int, count: int) -> np.ndarray:
        bits = (count - 1).bit_length()
        got = unpack_lines(take(-(-n * bits // 8)), n, 1, bits)[0]
        if (got >= count).any():
            raise BadFile("an index is out of range")
        return got

    for y in range(0, h, 16):
        for x in range(0, w, 16):
            bh, bw = min(16, h - y), min(16, w - x)
            view, op = out[y : y + bh, x : x + bw], take(1)[0]
            seen = 3 if channels == 1 else channels
            if op == 0:
                view[..., :seen] = colours(bw * bh).reshape(bh, bw, seen)
            elif op == 1:
                view[..., :seen] = colours(1)[0]
            elif op in (2, 3, 7):
                if op == 7:
                    far, at = read_varint(data, at)
                    if not far or far > index or data[:4] != b"QBR1":
                        raise BadFile("a block refers to none")
                    sy, sx = (v * 16 for v in divmod(index - far, across))
                else:
                    sy, sx = (y, x - 16) if op == 2 else (y - 16, x)
                source = out[max(sy, 0) : sy + bh, max(sx, 0) : sx + bw]
                if sy < 0 or sx < 0 or source.shape != view.shape:
                    raise BadFile("a block refers to none of its size")
                view[:] = source.copy()
            elif op in (4, 5):
                n = 2 if op == 4 else take(1)[0]
                if op == 5 and n not in (3, 4):
                    raise BadFile("a block has too many colours")
                c = colours(n)
                view[..., :seen] = c[ids(bw * bh, n)].reshape(bh, bw, seen)
            elif op == 6:
                n = take(1)[0]
                if not 1 < n <= 16:
                    raise BadFile("a block has too many patterns")
                c = colours(4 * n).reshape(n, 2, 2, seen)
                got = ids(-(-bw // 2) * -(-bh // 2), n).reshape(-(-bh // 2), -(-bw // 2))
                view[..., :seen] = c[got].transpose(0, 2, 1, 3, 4).reshape(2 * got.shape[0], 2 * got.shape[1], seen)[:bh, :bw]
            else:
                raise BadFile("no such block operation")
            index += 1
    if at != len(data):
        raise BadFile("bytes follow the blocks")
    return out


# ---------------------------------------------------------------- palette moves, periodic gray, tiles


def palette_moves(ids: np.ndarray) -> bytes:
    """Runs that repeat the place left, above or up-left of each place, whichever comes first in this order, and single numbers."""
    h, w = ids.shape
    same = np.zeros((3, h, w), bool)
    same[0, :, 1:] = ids[:, 1:] == ids[:, :-1]
    same[1, 1:] = ids[1:] == ids[:-1]
    same[2, 1:, 1:] = ids[1:, 1:] == ids[:-1, :-1]
    same = same.reshape(3, -1)
    # how far each kind of run goes on: the next place where it breaks
    breaks = [np.append(np.flatnonzero(~s), s.size) for s in same]
    out, at, flat = bytearray(), 0, ids.ravel()
    while at < flat.size:
        kind = next((k for k in range(3) if same[k, at]), 3)
        if kind == 3:
            out += bytes([3]) + varint(int(flat[at]))
            at += 1
            continue
        end = int(breaks[kind][np.searchsorted(breaks[kind], at)])
        out += bytes([kind]) + varint(end - at - 1)
        at = end
    return bytes(out)


def read_palette_moves(data: bytes, w: int, h: int) -> np.ndarray:
    ids, at, n = np.zeros(w * h, np.int64), 0, 0
    while n < w * h:
        if at >= len(data) or data[at] > 3:
            raise BadFile("no such palette move")
        kind = data[at]
        value, at = read_varint(data, at + 1)
        if kind == 3:
            ids[n] = value
            n += 1
            continue
        run = value + 1
        places = np.arange(n, n + min(run, w * h + 1))
        if run > w * h - n or (kind != 1 and (places % w == 0).any()) or (kind and n < w):
            raise BadFile("a palette move has no source")
        back = (1, w, w + 1)[kind]
        for i in range(n, n + run, back):  # a source may lie in the run itself
            part = min(back, n + run - i)
            ids[i : i + part] = ids[i - back : i - back + part]
        n += run
    if at != len(data):
        raise BadFile("bytes follow the palette moves")
    return ids.reshape(h, w)


def periodic(gray: np.ndarray, period: int) -> bytes:
    """Rests of a plane with slopes along x and y and a pattern of period by period, commonest rest at each place."""
    h, w = gray.shape
    v = gray.astype(np.int64)
    circle = lambda d: np.minimum(d & 255, 256 - (d & 255))

    def slope(d: np.ndarray) -> int:
        hist = np.bincount((d & 255).ravel(), minlength=256)
        return int((circle(np.arange(256)[None] - np.arange(256)[:, None] * period) * hist).sum(1).argmin()) if d.size else 0

    a, b = slope(v[:, period:] - v[:, :-period]), slope(v[period:] - v[:-period])
    y, x = np.mgrid[:h, :w]
    rest = (v - a * x - b * y) & 255
    place = (y % period) * period + x % period
    phase = np.bincount((place * 256 + rest).ravel(), minlength=256 * period * period).reshape(-1, 256).argmax(1)
    return bytes([period, 0, a, b]) + phase.astype(np.uint8).tobytes() + ((rest - phase[place]) & 255).astype(np.uint8).tobytes()


def read_periodic(data: bytes, w: int, h: int) -> np.ndarray:
    if len(data) < 4 or data[0] not in (8, 16, 32) or data[1] not in (0, 8, 16):
        raise BadFile("a periodic model's parameters are invalid")
    p, block, a, b = data[:4]
    across, down = (-(-w // block), -(-h // block)) if block else (0, 0)
    if len(data) != 4 + p * p + across * down + w * h:
        raise BadFile("a periodic model has another size")
    phase = np.frombuffer(data[4 : 4 + p * p], np.uint8).astype(np.int64)
    bases = np.frombuffer(data[4 + p * p : 4 + p * p + across * down], np.uint8)
    body = np.frombuffer(data[4 + p * p + across * down :], np.uint8).astype(np.int64)
    y, x = np.mgrid[:h, :w]
    rest = body.reshape(h, w)
    if block:  # rests stand block by block
        rest, at = np.zeros((h, w), np.int64), 0
        for i, base in enumerate(bases.tolist()):
            view = rest[i // across * block :, i % across * block :][:block, :block]
            view[:] = body[at : at + view.size].reshape(view.shape) + base
            at += view.size
    return ((rest + a * x + b * y + phase[(y % p) * p + x % p]) & 255).astype(np.uint8)


def tiled(rgba: np.ndarray, height: int, mode: int = 0) -> tuple[int, bytes]:
    """Channels and payload: bands of lines, each a native stream of its own."""
    channels = {GRAY: 1, RGB: 3}.get(mode_of(rgba), 4)
    parts = []
    for y in range(0, len(rgba), height):
        parts.append(native.encode(rgba[y : y + height], mode=mode, channels=channels))
    return channels, struct.pack(f"<{1 + len(parts)}I", len(parts), *map(len, parts)) + b"".join(parts)


def read_tiled(data: bytes, h: Header) -> np.ndarray:
    count = int.from_bytes(data[:4], "little")
    if count != -(-h.height // h.count) or count > 65_536 or len(data) < 4 + 4 * count:
        raise BadFile("the tile table is invalid")
    sizes, at, out = struct.unpack_from(f"<{count}I", data, 4), 4 + 4 * count, []
    if at + sum(sizes) != len(data):
        raise BadFile("tiles have another size")
    for i, size in enumerate(sizes):
        part = native.decode(data[at : at + size])
        if part.shape[:2] != (min(h.count, h.height - i * h.count), h.width):
            raise BadFile("a tile has other dimensions")
        out.append(part)
        at += size
    return np.concatenate(out)


def _as_stream(lines: bytes, width: int) -> bytes:
    """Bytes as a gray native stream."""
    gray = np.frombuffer(lines, np.uint8).reshape(-1, width)
    return native.encode(np.dstack([gray, gray, gray, np.full_like(gray, 255)]))


def _from_stream(data: bytes, width: int, height: int) -> bytes:
    image = native.decode(data)
    if image.shape[:2] != (height, width) or data[12] != 1:
        raise BadFile("a stream has other dimensions")
    return np.ascontiguousarray(image[..., 0]).tobytes()


# ---------------------------------------------------------------- container


def container(w: int, h: int, mode: int, transform: int, bits: int, count: int, payload: bytes, palette: bytes = b"") -> bytes:
    head = MARK + struct.pack("<II4BIQ", w, h, mode, transform, bits, CRC_FLAG, count, len(payload))
    body = head + palette + payload
    return body + struct.pack("<I", zlib.crc32(body))


def header(data: bytes) -> Header:
    """The checked header. Dimensions and limits come before the checksum."""
    if len(data) > MAX_FILE or len(data) < 32 or data[:4] != MARK:
        raise BadFile("not a container")
    w, h, mode, transform, bits, codec, count, size = struct.unpack_from("<II4BIQ", data, 4)
    if not w or not h or w * h > MAX_PIXELS or size > MAX_PAYLOAD:
        raise BadFile("limit exceeded")
    if not codec & CRC_FLAG or codec & ~(CRC_FLAG | 3) or codec & 3 not in (0, 3):
        raise BadFile("invalid codec")
    if mode not in (*range(1, 6), 7, *range(9, 19)) or transform > 10:
        raise BadFile("invalid mode or transform")
    has_palette = mode in (PALETTE, PSTREAM, PPAL)
    fine = bits in range(1, 17) and 0 < count <= min(65_536, 1 << bits)
    wrong = (
        (mode in (NATIVE, GMODEL) and (transform or bits or count))
        or (mode == FILTERED and (bits not in range(1, 5) or count))
        or ((has_palette or mode == CPAL) and not fine)
        or (mode == PPAL and transform != RUNS)
        or (mode == CPAL and transform not in (RAW, RUNS, PAL_DELTA))
        or (mode in (TILES, TILE_MODEL) and (bits not in (1, 3, 4) or not count or transform or (mode == TILE_MODEL and codec & 3)))
        or (mode == ANIM and (transform or bits or not count))
        or (mode == BLOCKS and (transform or bits not in (16, 64) or count or codec & 3))
        or (mode in (GRAY, GRAYA, RGB, RGBA, SEPARABLE) and count)
    )
    if wrong:
        raise BadFile("a header's fields don't fit its mode")
    if mode == ANIM and (count > MAX_FRAMES or count * (w * h * 4 + 16) > MAX_ANIMATION):
        raise BadFile("limit exceeded: animation")
    if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise BadFile("checksum differs")
    return Header(w, h, mode, transform, bits, codec & 3, count, size)


def candidates(rgba: np.ndarray, families: tuple[str, ...] = ("raw", "rle", "filtered", "palette", "separable", "blocks", "periodic", "native")) -> Iterator[tuple[str, bytes]]:
    """Name and file of every way to store an image."""
    h, w = rgba.shape[:2]
    kind = mode_of(rgba)
    anchors = [(None, PLAIN, RAW, RLE)] + ([(1, GDELTA, GDELTA_RAW, GDELTA_RLE)] if kind in (RGB, RGBA) else [])
    for anchor, plain, raw, runs in anchors:
        s = samples(rgba, kind, anchor)
        name = "" if anchor is None else "green-"
        lines = s.reshape(h, -1)
        if "raw" in families:
            yield name + "raw", container(w, h, kind, raw, 0, 0, s.tobytes())
        if "rle" in families:
            yield name + "rle", container(w, h, kind, runs, 0, 0, rle(s.ravel()))
        if "filtered" in families:
            yield name + "filtered", container(w, h, kind, plain, 0, 0, filter_lines(lines, s.shape[2]))
    if "palette" in families:
        packed = np.ascontiguousarray(rgba).view(">u4")[..., 0]
        colours, ids = np.unique(packed, return_inverse=True)
        if len(colours) <= 65_536:
            ids, bits, palette = ids.reshape(h, w), index_bits(len(colours)), colours.astype(">u4").tobytes()
            lines = pack_lines(ids, bits)
            yield "palette", container(w, h, PALETTE, RAW, bits, len(colours), lines, palette)
            yield "palette-rle", container(w, h, PALETTE, RLE, bits, len(colours), rle(np.frombuffer(lines, np.uint8)), palette)
            runs = rle(ids.ravel(), True)
            yield "palette-runs", container(w, h, CPAL, RUNS, bits, len(colours), palette + runs)
            p = np.frombuffer(palette, np.uint8).reshape(-1, 4)
            delta = np.concatenate([p[:1], p[1:] - p[:-1]]).astype(np.uint8).tobytes()
            yield "palette-moves", container(w, h, PPAL, RUNS, bits, len(colours), palette_moves(ids), palette)
            if "streams" in families:
                line = len(lines) // h
                yield "palette-stream", container(w, h, PSTREAM, RAW, bits, len(colours), _as_stream(lines, line), palette)
                yield "palette-filtered-stream", container(w, h, PSTREAM, PLAIN, bits, len(colours), _as_stream(filter_lines(np.frombuffer(lines, np.uint8).reshape(h, line), 1), line + 1), palette)
            yield "palette-delta", container(w, h, CPAL, PAL_DELTA, bits, len(colours), delta + runs)
    if "separable" in families:
        s = samples(rgba, kind)
        if ((s[:1] + s[:, :1] - s[:1, :1]) == s).all():
            row, column = s[0], s[1:, 0]
            yield "separable", container(w, h, SEPARABLE, RAW, kind, 0, row.tobytes() + column.tobytes())
            steps = np.concatenate([row[:1], row[1:] - row[:-1]]), np.concatenate([column, s[:1, 0]])[: h - 1] - np.concatenate([s[:1, 0], column])[: h - 1]
            yield "separable-delta", container(w, h, SEPARABLE, SEP_DELTA, kind, 0, steps[0].tobytes() + steps[1].tobytes())
    if "blocks" in families:
        yield "blocks", container(w, h, BLOCKS, PLAIN, 16, 0, encode_blocks(rgba))
    if "regions" in families:
        for layout, size in regions.SIZES.items():
            yield layout.decode(), container(w, h, BLOCKS, PLAIN, size, 0, regions.encode(rgba, layout))
    if "periodic" in families and kind == GRAY and w * h <= 2_097_152:
        for period in (8, 16, 32):
            yield f"periodic-{period}", container(w, h, GMODEL, PLAIN, 0, 0, periodic(rgba[..., 0], period))
    if "streams" in families:
        s = samples(rgba, kind)
        yield "filtered-stream", container(w, h, FILTERED, PLAIN, kind, 0, _as_stream(filter_lines(s.reshape(h, -1), s.shape[2]), s[0].size + 1))
    if "tiles" in families:
        channels, payload = tiled(rgba, TILE)
        yield "tiles", container(w, h, TILES, PLAIN, channels, TILE, payload)
    if "tile-models" in families:
        channels = {GRAY: 1, RGB: 3}.get(kind, 4)
        yield "tile-models", container(w, h, TILE_MODEL, PLAIN, channels, TILE, tile_models.encode(rgba[..., :channels], TILE, filter_lines))
    if "native" in families:
        yield "native", container(w, h, NATIVE, PLAIN, 0, 0, native.encode(rgba))


def encode(rgba: np.ndarray, families: tuple[str, ...] | None = None) -> tuple[str, bytes]:
    """The smallest candidate, the first of equals."""
    return min(candidates(rgba, families) if families else candidates(rgba), key=lambda c: len(c[1]))


def decode(data: bytes) -> np.ndarray:
    """The pixels (height, width, 4) of a still image."""
    h = header(data)
    if h.codec:
        raise BadFile("the outer codec is not supported")
    own = 4 * h.count if h.mode in (PALETTE, PSTREAM, PPAL) else 0
    palette, payload = data[28 : 28 + own], data[28 + own : -4]
    if len(payload) != h.payload:
        raise BadFile("the payload has another size")
    if h.mode == NATIVE:
        out = native.decode(payload)
        if out.shape[:2] != (h.height, h.width):
            raise BadFile("the native stream has other dimensions")
        return out
    if h.mode == BLOCKS:
        if payload[:4] in regions.SIZES:
            if regions.SIZES[payload[:4]] != h.bits:
                raise BadFile("a region program has another block size")
            return regions.decode(payload, h.width, h.height)
        return decode_blocks(payload, h.width, h.height)
    if h.mode == CPAL:
        colours, rest = np.frombuffer(payload[: 4 * h.count], np.uint8), payload[4 * h.count :]
        if len(colours) != 4 * h.count:
            raise BadFile("the palette is cut off")
        colours = colours.reshape(-1, 4)
        if h.transform == PAL_DELTA:
            colours = np.cumsum(colours, 0).astype(np.uint8)
        return _looked_up(unpack_lines(rest, h.width, h.height, h.bits) if h.transform == RAW else unrle(rest, h.width * h.height, True).reshape(h.height, h.width), colours)
    if h.mode == SEPARABLE:
        return _separable(payload, h)
    if h.mode == TILES:
        return read_tiled(payload, h)
    if h.mode == TILE_MODEL:
        s = tile_models.decode(payload, h.width, h.height, h.count, h.bits, unfilter_lines)
        return unsamples(s, h.bits)
    if h.mode == GMODEL:
        gray = read_periodic(payload, h.width, h.height)
        return unsamples(gray[..., None], GRAY)
    if h.mode == PPAL:
        return _looked_up(read_palette_moves(payload, h.width, h.height), np.frombuffer(palette, np.uint8).reshape(-1, 4))
    if h.mode in (PSTREAM, FILTERED):
        line = -(-h.width * h.bits // 8) if h.mode == PSTREAM else h.width * h.bits
        step = h.bits if h.mode == FILTERED else 2 if h.bits == 16 else 1
        if h.mode == PSTREAM and h.transform == RAW:
            lines = _from_stream(payload, line, h.height)
        else:
            lines = unfilter_lines(_from_stream(payload, line + 1, h.height), line, h.height, step).tobytes()
        if h.mode == PSTREAM:
            return _looked_up(unpack_lines(lines, h.width, h.height, h.bits), np.frombuffer(palette, np.uint8).reshape(-1, 4))
        anchor = 1 if h.transform in (GDELTA, GDELTA_RAW, GDELTA_RLE) else {RDELTA: 0, BDELTA: 2}.get(h.transform)
        return unsamples(np.frombuffer(lines, np.uint8).reshape(h.height, h.width, h.bits), h.bits, anchor if h.bits >= RGB else None)
    if h.mode == PALETTE:
        line = -(-h.width * h.bits // 8)
        size, step = line * h.height, 2 if h.bits == 16 else 1
    elif h.mode <= RGBA:
        line, step = h.width * h.mode, h.mode
        size = line * h.height
    else:
        raise BadFile(f"mode {h.mode} is not supported")
    if h.transform in (RLE, GDELTA_RLE):
        lines = unrle(payload, size).astype(np.uint8).tobytes()
    elif h.transform in (RAW, GDELTA_RAW):
        lines = payload
    else:
        lines = unfilter_lines(payload, line, h.height, step).tobytes()
    if len(lines) != size:
        raise BadFile("samples have another size")
    if h.mode == PALETTE:
        return _looked_up(unpack_lines(lines, h.width, h.height, h.bits), np.frombuffer(palette, np.uint8).reshape(-1, 4))
    anchor = 1 if h.transform in (GDELTA, GDELTA_RAW, GDELTA_RLE) else {RDELTA: 0, BDELTA: 2}.get(h.transform)
    return unsamples(np.frombuffer(lines, np.uint8).reshape(h.height, h.width, h.mode), h.mode, anchor if h.mode >= RGB else None)


def _looked_up(ids: np.ndarray, colours: np.ndarray) -> np.ndarray:
    if (ids >= len(colours)).any():
        raise BadFile("an index is out of range")
    return colours[ids]


def _separable(payload: bytes, h: Header) -> np.ndarray:
    if h.bits not in range(1, 5) or len(payload) != (h.width + h.height - 1) * h.bits:
        raise BadFile("separable lines have another size")
    s = np.frombuffer(payload, np.uint8).reshape(-1, h.bits)
    row, column = s[: h.width], s[h.width :]
    if h.transform == SEP_DELTA:
        row = np.cumsum(row, 0).astype(np.uint8)
        column = np.cumsum(np.concatenate([row[:1], column]), 0).astype(np.uint8)[1:]
    first = np.concatenate([row[:1], column])
    return unsamples(row[None] + first[:, None] - row[:1, None], h.bits)


# ---------------------------------------------------------------- animation


def find_move(old: np.ndarray, new: np.ndarray, box: tuple[int, int, int, int], least: int = 4) -> tuple[int, ...] | None:
    """source x and y, target x and y, width, height and colour (little-endian) of a move that alone makes the new frame of the old, or None. Places vote with patches of
    two by two pixels that the old frame's box holds once; the rectangle is what the winning shifts explain."""
    y0, x0, y1, x1 = box
    if not 64 <= (y1 - y0) * (x1 - x0) <= 262_144 or y1 - y0 < 2 or x1 - x0 < 2:
        return None
    packed = [np.ascontiguousarray(f).view("<u4")[..., 0].astype(np.uint64) for f in (old, new)]
    patches = [f[y0 : y1 - 1, x0 : x1 - 1] * np.uint64(0x9E3779B97F4A7C15) ^ f[y0 : y1 - 1, x0 + 1 : x1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ f[y0 + 1 : y1, x0 : x1 - 1] * np.uint64(0x165667B19E3779F9) ^ f[y0 + 1 : y1, x0 + 1 : x1] * np.uint64(0x27D4EB2F165667C5) for f in packed]
    keys, first, count = np.unique(patches[0], return_index=True, return_counts=True)
    keys, first = keys[count == 1], first[count == 1]
    if not len(keys):
        return None
    ys, xs = np.nonzero((packed[0] != packed[1])[y0 : y1 - 1, x0 : x1 - 1])
    want = patches[1][ys, xs]
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    hit = keys[at] == want
    sy, sx = np.divmod(first[at[hit]], x1 - x0 - 1)
    shifts, votes = np.unique(np.stack([ys[hit] - sy, xs[hit] - sx], 1), axis=0, return_counts=True)
    h, w = new.shape[:2]
    for i in np.argsort(-votes, kind="stable")[:16]:
        dy, dx = (int(v) for v in shifts[i])
        if votes[i] < least or not (dy or dx):
            continue
        moved = np.zeros((h, w), bool)  # changed places that the shift explains
        a, b, c, d = max(dy, 0), h + min(dy, 0), max(dx, 0), w + min(dx, 0)
        moved[a:b, c:d] = packed[1][a:b, c:d] == packed[0][a - dy : b - dy, c - dx : d - dx]
        ys2, xs2 = np.nonzero(moved & (packed[0] != packed[1]))
        if not len(ys2):
            continue
        ty, tx, mh, mw = int(ys2.min()), int(xs2.min()), int(np.ptp(ys2)) + 1, int(np.ptp(xs2)) + 1
        by, bx = ty - dy, tx - dx
        if by < 0 or bx < 0 or by + mh > h or bx + mw > w:
            continue
        left = np.ones((h, w), bool)
        left[ty : ty + mh, tx : tx + mw] = False
        bared = new[by : by + mh, bx : bx + mw][left[by : by + mh, bx : bx + mw]]
        if not len(bared):
            continue
        made = old.copy()
        made[by : by + mh, bx : bx + mw] = bared[0]
        made[ty : ty + mh, tx : tx + mw] = old[by : by + mh, bx : bx + mw]
        if np.array_equal(made, new):
            return bx, by, tx, ty, mw, mh, int.from_bytes(bared[0].tobytes(), "little")
    return None


def encode_animation(frames: list[np.ndarray], delays: list[int], loop: int, families: tuple[str, ...] | None = None) -> bytes:
    """Key frames, duplicates, moves and rectangles of at most half a frame; a rectangle gives way to a key frame that is smaller."""
    h, w = frames[0].shape[:2]
    out, last_key = [b"QAN2", struct.pack("<II", len(frames), loop)], None
    for i, (frame, delay) in enumerate(zip(frames, delays)):
        lead = struct.pack("<I", delay or 100)
        if i and (changed := np.argwhere((frame != frames[i - 1]).any(2))).size == 0:
            out.append(lead + struct.pack("<I", DUPLICATE))
            continue
        if i:
            (y0, x0), (y1, x1) = changed.min(0), changed.max(0) + 1
            if move := find_move(frames[i - 1], frame, (y0, x0, y1, x1)):
                out.append(lead + struct.pack("<8I", MOVE, *move))
                continue
            if 2 * (y1 - y0) * (x1 - x0) <= w * h:
                part = encode(frame[y0:y1, x0:x1], families)[1]
                if len(part) + 16 < last_key or len(part) + 16 <= len(encode(frame, families)[1]):
                    out.append(lead + struct.pack("<5IQ", RECTANGLE, x0, y0, x1 - x0, y1 - y0, len(part)) + part)
                    continue
        whole = encode(frame, families)[1]
        last_key = len(whole)
        out.append(lead + struct.pack("<IQ", KEY, len(whole)) + whole)
    return container(w, h, ANIM, PLAIN, 0, len(frames), b"".join(out))


def decode_animation(data: bytes) -> tuple[list[np.ndarray], list[int], int]:
    """Frames, delays and loops, from either layout of sequences."""
    head = header(data)
    payload, at = data[28:-4], 12
    if head.mode != ANIM or head.codec or len(payload) != head.payload or payload[:4] not in (b"QAN1", b"QAN2"):
        raise BadFile("not a sequence")
    count, loop = struct.unpack_from("<II", payload.ljust(12, b"\0"), 4)
    if count != head.count:
        raise BadFile("another number of frames")

    def take(form: str) -> tuple:
        nonlocal at
        size = struct.calcsize(form)
        if at + size > len(payload):
            raise BadFile("the frame table is cut off")
        at += size
        return struct.unpack_from(form, payload, at - size)

    def still(w: int, h: int) -> np.ndarray:
        nonlocal at
        (size,) = take("<Q")
        if at + size > len(payload):
            raise BadFile("a frame is cut off")
        part = payload[at : at + size]
        at += size
        if header(part).mode == ANIM:
            raise BadFile("a frame is a sequence")
        image = decode(part)
        if image.shape[:2] != (h, w):
            raise BadFile("a frame has other dimensions")
        return image

    frames, delays = [], []
    for i in range(count):
        delay, kind = take("<II")
        delays.append(delay or 100)
        if payload[:4] == b"QAN1":
            kind = KEY
        if i == 0 and kind != KEY:
            raise BadFile("a sequence begins with a key frame")
        if kind == KEY:
            frames.append(still(head.width, head.height))
        elif kind == DUPLICATE:
            frames.append(frames[-1].copy())
        elif kind in (RECTANGLE, MOVE):
            box = take("<4I" if kind == RECTANGLE else "<7I")
            (x, y, w, h) = box if kind == RECTANGLE else (box[2], box[3], box[4], box[5])
            corners = [(x, y)] + ([(box[0], box[1])] if kind == MOVE else [])
            if not w or not h or any(cx + w > head.width or cy + h > head.height for cx, cy in corners):
                raise BadFile("a rectangle lies outside")
            frame = frames[-1].copy()
            if kind == RECTANGLE:
                frame[y : y + h, x : x + w] = still(w, h)
            else:
                frame[box[1] : box[1] + h, box[0] : box[0] + w] = np.frombuffer(struct.pack("<I", box[6]), np.uint8)
                frame[y : y + h, x : x + w] = frames[-1][box[1] : box[1] + h, box[0] : box[0] + w]
            frames.append(frame)
        else:
            raise BadFile("no such frame kind")
    if at != len(payload):
        raise BadFile("bytes follow the frames")
    return frames, delays, loop
