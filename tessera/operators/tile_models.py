"""Tile models: bands of lines, each under the one of nine predictions whose residuals make the smallest native stream."""

from __future__ import annotations

import struct

import numpy as np

from tessera.operators import native
from tessera.operators.native import BadFile

PLAIN, FILTERED, LEFT, UP, SLOPE, ACROSS, DOWN, PLANAR, RULE = range(9)
#: Thresholds (low, high, gap) that a rule is fitted from, besides those from the tile's own quartiles.
SEEDS = [(8, 48, 0), (16, 64, 4), (24, 96, 8), (32, 128, 16), (8, 96, 16), (48, 160, 16)]


def near(t: np.ndarray, y: int, x: int) -> tuple:
    """left, up, corner, two left, two up of a pixel's channels (0 outside, the nearer one for the farther), and whether there is a left and an up."""
    none = np.zeros(t.shape[2], np.int64)
    left, up = (t[y, x - 1] if x else none), (t[y - 1, x] if y else none)
    return left, up, t[y - 1, x - 1] if x and y else none, t[y, x - 2] if x > 1 else left, t[y - 2, x] if y > 1 else up, x > 0, y > 0


def slope(left, up, corner):
    return np.clip(left + up - corner, 0, 255)


def paeth(left, up, corner):
    a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def energy(n: tuple) -> np.ndarray:
    left, up, corner, left2, up2, has_left, has_up = n
    if has_left and has_up:
        e = abs(left - up) + abs(left - corner) + abs(up - corner)
    else:
        e = abs(left - left2) if has_left else abs(up - up2)
    return np.minimum(e, 255)


def branch(n: tuple, low: int, high: int, gap: int) -> np.ndarray:
    """Which of four cases each channel is in: smooth, along the line, along the column, rough."""
    left, up, _, left2, up2, has_left, has_up = n
    e = energy(n)
    sx, sy = (abs(left - left2) if has_left else np.full_like(e, 512)), (abs(up - up2) if has_up else np.full_like(e, 512))
    return np.where(e <= low, 0, np.where(sx + gap < sy, 1, np.where(sy + gap < sx, 2, np.where(e >= high, 3, 0))))


def choices(n: tuple) -> np.ndarray:
    left, up, corner, _, _, has_left, has_up = n
    return np.stack([slope(left, up, corner), paeth(left, up, corner), left if has_left else up, up if has_up else left])


def prediction(model: int, params: bytes, n: tuple, y: int, x: int, h: int, w: int) -> np.ndarray:
    left, up, corner, left2, up2, has_left, has_up = n
    if model == LEFT:
        return left
    if model == UP:
        return up
    if model == ACROSS:
        return np.clip(2 * left - left2, 0, 255) if has_left else left
    if model == DOWN:
        return np.clip(2 * up - up2, 0, 255) if has_up else up
    if model == PLANAR:
        base, right, low = np.frombuffer(params, np.uint8).astype(np.int64).reshape(-1, 3).T
        part = lambda d, at, last: np.sign(d) * (abs(d) * at // last) if last else 0 * d
        return base + part(right - base, x, w - 1) + part(low - base, y, h - 1) & 255
    if model == RULE:
        pick = params[2] >> 2 * branch(n, params[0], params[1], params[3]) & 3
        return np.take_along_axis(choices(n), pick[None], 0)[0]
    return slope(left, up, corner)


def quartiles(tile: np.ndarray) -> tuple[int, int]:
    """Energies that a quarter and three quarters of the samples don't pass, at least one apart."""
    h, w, c = tile.shape
    hist = np.zeros(256, np.int64)
    for y in range(h):
        for x in range(w):
            np.add.at(hist, energy(near(tile, y, x)), 1)
    total, upto = h * w * c, np.cumsum(hist)
    a, b = int(np.argmax(upto >= total // 4)), int(np.argmax(upto >= total * 3 // 4))
    if b <= a:
        b = min(255, a + 16)
        if b <= a:
            a -= 1
    return a, b


def fit_rule(tile: np.ndarray) -> bytes:
    """Thresholds and each case's prediction with the least sum of residual sizes; ties to what comes first."""
    low, high = quartiles(tile)
    best = None
    for a, b, gap in [*SEEDS, (low, high, 8), (low >> 1, high, 16)]:
        if b <= a:
            continue
        sums = np.zeros((4, 4), np.int64)
        for y in range(tile.shape[0]):
            for x in range(tile.shape[1]):
                n = near(tile, y, x)
                d = (tile[y, x] - choices(n)) & 255
                np.add.at(sums, (branch(n, a, b, gap)[None].repeat(4, 0), np.arange(4)[:, None].repeat(d.shape[1], 1)), np.minimum(d, 256 - d))
        picks = sums.argmin(1)
        total = int(sums.min(1).sum())
        if best is None or total < best[0]:
            best = total, bytes([a, b, int((picks << 2 * np.arange(4)).sum()), gap])
    return best[1]


def _stream(planes: np.ndarray) -> bytes:
    channels = planes.shape[2]
    image = np.full((*planes.shape[:2], 4), 255, np.uint8)
    image[..., : max(3, channels)] = np.repeat(planes, 3, 2) if channels == 1 else planes
    return native.encode(image, channels=channels)


def encode_tile(tile: np.ndarray, filter_lines, models: tuple[int, ...] = tuple(range(9))) -> tuple[int, bytes]:
    """The model of the smallest stream and the stream, its parameters before it; ties to the first. tile: lines, pixels, channels."""
    h, w, channels = tile.shape
    wide, best = tile.astype(np.int64), None
    for model in models:
        params = b""
        if model == PLAIN:
            data = _stream(tile)
        elif model == FILTERED:
            lines = np.frombuffer(filter_lines(tile.reshape(h, -1), channels), np.uint8).reshape(h, -1, 1)
            data = _stream(lines)
        else:
            if model == PLANAR:
                params = np.stack([tile[0, 0], tile[0, -1], tile[-1, 0]], 1).tobytes()
            elif model == RULE:
                params = fit_rule(wide)
            rest = np.array([[tile[y, x] - prediction(model, params, near(wide, y, x), y, x, h, w) for x in range(w)] for y in range(h)])
            data = params + _stream((rest & 255).astype(np.uint8).reshape(tile.shape))
        if best is None or len(data) < len(best[1]):
            best = model, data
    return best


def decode_tile(model: int, data: bytes, w: int, h: int, channels: int, unfilter_lines) -> np.ndarray:
    if model > RULE:
        raise BadFile("no such tile model")
    n = {PLANAR: 3 * channels, RULE: 4}.get(model, 0)
    params, stream = data[:n], data[n:]
    if len(params) < n or (model == RULE and params[1] <= params[0]):
        raise BadFile("a tile's parameters are invalid")
    shape = (h, w * channels + 1, 1) if model == FILTERED else (h, w, channels)
    image = native.decode(stream)
    if image.shape[:2] != shape[:2] or stream[12] != shape[2]:
        raise BadFile("a tile has other dimensions")
    if model == FILTERED:
        return unfilter_lines(np.ascontiguousarray(image[..., 0]).tobytes(), w * channels, h, channels).reshape(h, w, channels)
    out = image[..., :channels].astype(np.int64)
    if model != PLAIN:
        for y in range(h):
            for x in range(w):
                out[y, x] = out[y, x] + prediction(model, params, near(out, y, x), y, x, h, w) & 255
    return out.astype(np.uint8)


def encode(samples: np.ndarray, height: int, filter_lines) -> bytes:
    tiles = [encode_tile(samples[y : y + height], filter_lines) for y in range(0, len(samples), height)]
    table = b"".join(struct.pack("<BI", model, len(data)) for model, data in tiles)
    return struct.pack("<I", len(tiles)) + table + b"".join(data for _, data in tiles)


def decode(payload: bytes, w: int, h: int, height: int, channels: int, unfilter_lines) -> np.ndarray:
    count = int.from_bytes(payload[:4], "little")
    at = 4 + 5 * count
    if count != -(-h // height) or count > 65_536 or len(payload) < at:
        raise BadFile("the tile table is invalid")
    out = []
    for i in range(count):
        model, size = struct.unpack_from("<BI", payload, 4 + 5 * i)
        if at + size > len(payload):
            raise BadFile("a tile is cut off")
        out.append(decode_tile(model, payload[at : at + size], w, min(height, h - i * height), channels, unfilter_lines))
        at += size
    if at != len(payload):
        raise BadFile("bytes follow the tiles")
    return np.concatenate(out)
