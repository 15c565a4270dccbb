"""Region programs: predictors for blocks of 16 or regions of 64, and one native stream of folded residuals for the whole image.

Three layouts share a walk. QBL2 has an operation and its parameters for each block of 16; QPD1 a mixture with all its
parameters for each region of 64; QCF1 only the mixture's five coordinates, its bases being read off the border already decoded.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from itertools import product

import numpy as np

from tessera.operators import native
from tessera.operators.native import BadFile

ZERO, FLAT, GRADIENT, LEFT, UP, CAUSAL, MIXTURE = range(7)
SIZES = {b"QBL2": 16, b"QPD1": 64, b"QCF1": 64}


def fold(d: np.ndarray) -> np.ndarray:
    """Differences of bytes, as signed bytes, to unsigned ones that alternate."""
    s = ((d + 128) & 255) - 128
    return np.where(s >= 0, 2 * s, -2 * s - 1)


def unfold(v: int) -> int:
    return -((v + 1) >> 1) if v & 1 else v >> 1


def signed(v: int) -> int:
    return v - 256 if v > 127 else v


def saturated(v: int) -> int:
    return min(255, max(0, v))


def lerp(a: int, b: int, q: int) -> int:
    return (a * (15 - q) + b * q + 7) // 15


def between(a: int, b: int, at: int, last: int) -> int:
    return (a * (last - at) + b * at + last // 2) // last if last else a


def causal(p: list, x: int, y: int, straight: bool) -> int:
    """Paeth over the neighbours there are, or their clamped plane."""
    if not x and not y:
        return 0
    w = p[y][x - 1] if x else p[y - 1][x]
    n = p[y - 1][x] if y else w
    nw = p[y - 1][x - 1] if x and y else n
    if straight and x and y:
        return saturated(w + n - nw)
    return min(((abs(n - nw), 0, w), (abs(w - nw), 1, n), (abs(w + n - 2 * nw), 2, nw)))[2]


def mixture(p: list, x0: int, y0: int, w: int, h: int, x: int, y: int, size: int, q: tuple[int, ...], flat: int, corners: tuple[int, ...], left: int, up: int) -> int:
    """A sample from five coordinates of 0 to 15: whole to block, up to left, flat to gradient, axis to edge, Paeth to plane."""
    near, plane = causal(p, x, y, False), causal(p, x, y, True)
    beside = saturated(p[y][x - size] + left) if x0 >= size else near
    above = saturated(p[y - size][x] + up) if y0 >= size else near
    around = lerp(lerp(above, beside, q[1]), lerp(near, plane, q[4]), q[3])
    return lerp(around, lerp(flat, gradient(corners, x - x0, y - y0, w, h), q[2]), q[0])


def gradient(c: tuple[int, ...], dx: int, dy: int, w: int, h: int) -> int:
    if h == 1:
        return between(c[0], c[1], dx, w - 1)
    return between(between(c[0], c[1], dx, w - 1), between(c[2], c[3], dx, w - 1), dy, h - 1)


def border(p: list, x0: int, y0: int, w: int, h: int) -> tuple[int, tuple[int, ...]]:
    """Mean and corners of a region from the line above and the column left of it."""
    above, beside = (p[y0 - 1][x0 : x0 + w] if y0 else []), ([p[y][x0 - 1] for y in range(y0, y0 + h)] if x0 else [])
    n = len(above) + len(beside)
    flat = (sum(above) + sum(beside) + n // 2) // n if n else 0
    corner = p[y0 - 1][x0 - 1] if x0 and y0 else flat
    right, low = (above[-1] if above else flat), (beside[-1] if beside else flat)
    return flat, (corner, right, low, saturated(right + low - corner))


def coordinates(data: bytes) -> tuple[int, ...]:
    return data[0] & 15, data[0] >> 4, data[1] & 15, data[1] >> 4, data[2] & 15


def packed(q: tuple[int, ...]) -> bytes:
    return bytes([q[0] | q[1] << 4, q[2] | q[3] << 4, q[4]])


def parameters(op: int, channels: int) -> int:
    return {FLAT: channels, GRADIENT: 4 * channels, LEFT: channels, UP: channels, MIXTURE: 3 + 7 * channels}.get(op, 0)


def predictor(layout: bytes, op: int, params: bytes, planes: list, c: int, x0: int, y0: int, w: int, h: int) -> Callable[[int, int], int]:
    """The prediction of a sample of channel c in a block, from samples before it."""
    p, size, channels = planes[c], SIZES[layout], len(planes)
    if layout == b"QCF1":
        q, (flat, corners) = coordinates(params), border(p, x0, y0, w, h)
        return lambda x, y: mixture(p, x0, y0, w, h, x, y, size, q, flat, corners, 0, 0)
    if op == MIXTURE:
        q, rest = coordinates(params), params[3:]
        flat, corners = rest[c], tuple(rest[channels + 4 * c : channels + 4 * c + 4])
        left, up = signed(rest[5 * channels + c]), signed(rest[6 * channels + c])
        return lambda x, y: mixture(p, x0, y0, w, h, x, y, size, q, flat, corners, left, up)
    if op == FLAT:
        return lambda x, y: params[c]
    if op == GRADIENT:
        corners = tuple(params[4 * c : 4 * c + 4])
        return lambda x, y: gradient(corners, x - x0, y - y0, w, h)
    if op == LEFT:
        return lambda x, y: saturated(p[y][x - size] + signed(params[c]))
    if op == UP:
        return lambda x, y: saturated(p[y - size][x] + signed(params[c]))
    if op == CAUSAL:
        return lambda x, y: causal(p, x, y, False)
    return lambda x, y: 0


def measured(planes: list, x0: int, y0: int, w: int, h: int, size: int) -> tuple[bytes, bytes, bytes, bytes]:
    """Flat, gradient, left and up parameters of a block from its samples."""

    def mean(values: list[int]) -> int:
        n, total = len(values), sum(values)
        return (total + n // 2) // n if total >= 0 else -((-total + n // 2) // n)

    cells = [(x, y) for y in range(y0, y0 + h) for x in range(x0, x0 + w)]
    step = lambda d: d - 256 if d > 128 else d + 256 if d < -128 else d
    shift = lambda p, dx, dy: min(127, max(-128, mean([step(p[y][x] - p[y - dy][x - dx]) for x, y in cells]))) & 255
    flat = bytes(mean([p[y][x] for x, y in cells]) for p in planes)
    corners = bytes(v for p in planes for v in (p[y0][x0], p[y0][x0 + w - 1], p[y0 + h - 1][x0], p[y0 + h - 1][x0 + w - 1]))
    left = bytes(shift(p, size, 0) for p in planes) if x0 >= size else bytes(len(planes))
    up = bytes(shift(p, 0, size) for p in planes) if y0 >= size else bytes(len(planes))
    return flat, corners, left, up


def score(d: int) -> int:
    return min(d, 256 - d).bit_length()


def encode(rgba: np.ndarray, layout: bytes = b"QBL2") -> bytes:
    """The payload of a region program: for each block the parameters of least score, then the residuals' stream."""
    opaque, gray = (rgba[..., 3] == 255).all(), (rgba[..., :1] == rgba[..., 1:3]).all()
    channels = 1 if opaque and gray else 3 if opaque else 4
    height, width = rgba.shape[:2]
    planes, size = [rgba[..., c].astype(int).tolist() for c in range(channels)], SIZES[layout]
    guesses, table = np.zeros((height, width, channels), int), bytearray()
    for y0 in range(0, height, size):
        for x0 in range(0, width, size):
            w, h = min(size, width - x0), min(size, height - y0)
            flat, corners, left, up = measured(planes, x0, y0, w, h, size)
            mixes = [packed(tuple(15 * b for b in q)) for q in product((0, 1), repeat=5)] + [packed((7,) * 5)]
            if layout == b"QBL2":
                options = [(ZERO, b""), (FLAT, flat), (GRADIENT, corners), (CAUSAL, b"")] + [(LEFT, left)] * (x0 >= size) + [(UP, up)] * (y0 >= size) + [(MIXTURE, packed((7,) * 5) + flat + corners + left + up)]
            else:
                options = [(MIXTURE, q if layout == b"QCF1" else q + flat + corners + left + up) for q in mixes]
            best = None
            for op, params in options:
                makers = [predictor(layout, op, params, planes, c, x0, y0, w, h) for c in range(channels)]
                guess = [[[m(x, y) for m in makers] for x in range(x0, x0 + w)] for y in range(y0, y0 + h)]
                cost = 20 * (1 + len(params)) + sum(score((planes[c][y0 + j][x0 + i] - g) & 255) for j, line in enumerate(guess) for i, cell in enumerate(line) for c, g in enumerate(cell))
                if best is None or cost < best[0]:
                    best = cost, op, params, guess
            _, op, params, guess = best
            table += (bytes([op]) if layout == b"QBL2" else b"") + params
            guesses[y0 : y0 + h, x0 : x0 + w] = guess
    rest = fold(rgba[..., :channels].astype(int) - guesses).astype(np.uint8)
    image = np.full((height, width, 4), 255, np.uint8)
    image[..., : max(3, channels)] = np.repeat(rest, 3, 2) if channels == 1 else rest
    stream = native.encode(image, channels=channels)
    return layout + bytes([size, channels, 0, 0]) + struct.pack("<IQ", len(table), len(stream)) + bytes(table) + stream


def decode(data: bytes, width: int, height: int) -> np.ndarray:
    layout = data[:4]
    if layout not in SIZES or len(data) < 20 or data[4] != SIZES[layout] or data[5] not in (1, 3, 4) or data[6:8] != b"\0\0":
        raise BadFile("a region program's header is invalid")
    size, channels = data[4], data[5]
    table_size, stream_size = struct.unpack_from("<IQ", data, 8)
    if 20 + table_size + stream_size != len(data):
        raise BadFile("a region program has another size")
    table, stream, at = data[20 : 20 + table_size], data[20 + table_size :], 0
    rest = native.decode(stream)
    if rest.shape[:2] != (height, width) or stream[12] != channels:
        raise BadFile("residuals have other dimensions")
    rest = rest[..., :channels].tolist()
    planes = [[[0] * width for _ in range(height)] for _ in range(channels)]
    for y0 in range(0, height, size):
        for x0 in range(0, width, size):
            w, h, op = min(size, width - x0), min(size, height - y0), MIXTURE
            if layout == b"QBL2":
                op, at = (table[at] if at < len(table) else 99), at + 1
            n = 3 if layout == b"QCF1" else parameters(op, channels)
            if op > MIXTURE or (op == LEFT and x0 < size) or (op == UP and y0 < size) or at + n > len(table):
                raise BadFile("a block's operation is invalid")
            params = table[at : at + n]
            at += n
            makers = [predictor(layout, op, params, planes, c, x0, y0, w, h) for c in range(channels)]
            for y in range(y0, y0 + h):
                for x in range(x0, x0 + w):
                    for c, make in enumerate(makers):
                        planes[c][y][x] = make(x, y) + unfold(rest[y][x][c]) & 255
    if at != len(table):
        raise BadFile("bytes follow the block table")
    out = np.full((height, width, 4), 255, np.uint8)
    got = np.stack([np.array(p, np.uint8) for p in planes], 2)
    out[..., : max(3, channels)] = np.repeat(got, 3, 2) if channels == 1 else got
    return out
