"""Coding: round trips over generated images, the one known file, damage."""

import numpy as np
import pytest

from tessera.operators import codec, native, regions, tile_models


def fill(w, h, seed):
    y, x = np.mgrid[:h, :w]
    a = np.where((x + y + seed) % 9 != 0, 255, x + y)
    return (np.stack([13 * x + 3 * y + seed, 5 * x + 17 * y + 7 * seed, 11 * (x ^ y) + 19 * seed, a], 2) & 255).astype(np.uint8)


def noise(w, h, seed=1, step=1):
    return (np.random.default_rng(seed).integers(0, 256, (h, w, 4)) // step * step).astype(np.uint8)


def images():
    y, x = np.mgrid[:33, :41]
    opaque = fill(23, 17, 73)
    opaque[..., 3] = 255
    gray = np.repeat(noise(20, 9, 2, 64)[..., :1], 4, 2)
    repeated = np.concatenate([noise(48, 32), noise(48, 32)])
    plane = np.stack([(3 * x + 5 * y) & 255] * 3 + [np.full_like(x, 255)], 2).astype(np.uint8)
    checker = np.where(((x >> 3) + (y >> 3))[..., None] % 2, [240, 28, 220, 255], [12, 180, 44, 255]).astype(np.uint8)
    return {"fill": fill(17, 19, 5), "opaque": opaque, "gray": gray, "one": fill(1, 1, 0), "row": fill(17, 1, 3), "column": fill(1, 17, 3), "repeated": repeated, "plane": plane, "checker": checker, "few": noise(30, 40, 3, 128), "flat": np.zeros((20, 50, 4), np.uint8)}


@pytest.mark.parametrize("name", images())
def test_tiles_of_few_lines(monkeypatch, name):
    monkeypatch.setattr(codec, "TILE", 4)
    image = images()[name]
    assert np.array_equal(codec.decode(dict(codec.candidates(image, ("tiles",)))["tiles"]), image)


def test_periodic_layouts():
    y, x = np.mgrid[:40, :50]
    gray = ((5 * x + 9 * y + 31 * ((x % 8) * (y % 8))) & 255).astype(np.uint8)
    data = codec.periodic(gray, 8)
    assert data[:4] == bytes([8, 0, 5, 9]) and not any(data[68:]) and np.array_equal(codec.read_periodic(data, 50, 40), gray)
    rest = np.frombuffer(data[68:], np.uint8).reshape(40, 50)
    parts = [rest[i : i + 16, j : j + 16] for i in range(0, 40, 16) for j in range(0, 50, 16)]
    blocks = bytes([8, 16, 5, 9]) + data[4:68] + bytes(range(len(parts))) + b"".join(((p - i) & 255).astype(np.uint8).tobytes() for i, p in enumerate(parts))
    assert np.array_equal(codec.read_periodic(blocks, 50, 40), gray)


@pytest.mark.parametrize("name", images())
def test_every_candidate_gives_the_image_back(name):
    image = images()[name]
    made = dict(codec.candidates(image, ("raw", "rle", "filtered", "palette", "separable", "blocks", "periodic", "streams", "native", "tiles")))
    for kind, data in made.items():
        assert np.array_equal(codec.decode(data), image), kind
    assert len(codec.encode(image)[1]) == min(len(d) for k, d in codec.candidates(image)) >= min(map(len, made.values()))


@pytest.mark.parametrize("transform", range(36))
def test_native_transforms_tiles_and_folding(transform):
    image = fill(13, 11, transform)
    for log, mode in ((0, 0), (2, 3)):
        assert np.array_equal(native.decode(native.encode(image, transform, log, mode)), image)


def test_every_filter_is_undone():
    lines = noise(8, 6)[..., 0]
    for kind in range(6):
        body = (lines - codec._predictions(lines, 2)[kind]) & 255
        data = np.concatenate([np.full((6, 1), kind), body], 1).astype(np.uint8).tobytes()
        assert np.array_equal(codec.unfilter_lines(data, 8, 6, 2), lines)


def test_known_file():
    data = bytes.fromhex("514c49430200000001000000" "0d0a0180" "02000000" "0c00000000000000" "0a141eff1e1e1e00" "00000001" "d55f29a8")
    assert codec.decode(data).tolist() == [[[10, 20, 30, 255], [40, 50, 60, 255]]]


def sequence():
    base = fill(64, 48, 41)
    changed = base.copy()
    changed[20:30, 33:40, :3] ^= np.array([0x5A, 0xA5, 0x3C], np.uint8)
    return [base, base, changed, fill(64, 48, 9)], [11, 0, 33, 5]


def test_sequences():
    frames, delays = sequence()
    data = codec.encode_animation(frames, delays, 7, ("raw", "palette"))
    got, times, loop = codec.decode_animation(data)
    assert all(map(np.array_equal, got, frames)) and times == [11, 100, 33, 5] and loop == 7
    assert len(data) < 3 * len(codec.encode(frames[0], ("raw",))[1])


def test_damage_is_told_and_gives_nothing():
    data = bytearray(codec.encode(fill(30, 20, 3))[1])
    for i in range(0, len(data), 7):
        bad = bytearray(data)
        bad[i] ^= 64
        with pytest.raises(codec.BadFile):
            codec.decode(bytes(bad))
        with pytest.raises(codec.BadFile):
            codec.decode(bytes(data[:i]))
    huge = codec.MARK + b"\xff" * 8 + bytes([9, 0, 0, 128]) + bytes(16)
    with pytest.raises(codec.BadFile, match="limit"):
        codec.decode(huge)


def test_random_bytes_do_not_crash_kernels():
    rng = np.random.default_rng(7)
    for _ in range(1500):
        junk = rng.integers(0, 256, rng.integers(0, 120)).astype(np.uint8).tobytes()
        for read in (lambda d: codec.decode_blocks(b"QBR1\x10\x03\0\0" + d, 20, 20), lambda d: codec.unrle(d, 50), lambda d: codec.unrle(d, 50, True)):
            try:
                read(junk)
            except codec.BadFile:
                pass


MODES = [m for m in range(55) if native.known(m)]


@pytest.mark.parametrize("mode", MODES)
def test_native_modes(mode):
    y, x = np.mgrid[:14, :19]
    smooth = np.stack([x * 3 + y, x * 3 + y + (x == 7), x + 2 * y, np.full_like(x, 255)], 2).astype(np.uint8)
    steps = np.stack([(x // 6) * 40 + (x == 11) * (y == 5), (y // 5) * 60, (x // 6) * 40, np.full_like(x, 200)], 2).astype(np.uint8)
    blank = np.full((9, 6, 4), 7, np.uint8)
    done = 0
    for image in (smooth, steps, blank, fill(9, 8, 1), noise(16, 12, 4, 64), np.repeat(noise(7, 9, 5, 32)[..., :1], 4, 2)):
        for log in (0,) if mode in (38, 39, 40) else (0, 2):
            try:
                data = native.encode(image, 5, log, mode, rate=4 if log else 0, reduce=bool(log))
            except native.BadFile:
                assert mode in (1, 39, 40)
                continue
            assert np.array_equal(native.decode(data), image)
            done += 1
    assert done >= 2


def test_native_damage_is_told():
    data = native.encode(fill(12, 9, 2), 2, 3, 36)
    for i in range(30):
        bad = data[:i] + bytes([data[i] ^ 32]) + data[i + 1 :]
        try:
            assert np.array_equal(native.decode(bad), fill(12, 9, 2)) and 26 <= i < 30  # the stream's own checksum isn't read
        except native.BadFile:
            pass
    rng = np.random.default_rng(3)
    for mode in MODES:
        junk = data[:14] + bytes([mode]) + data[15:16] + (b"\0" if mode in (38, 39, 40) else b"\2") + data[17:22] + (200).to_bytes(4, "little") + bytes(4) + rng.integers(0, 256, 200).astype(np.uint8).tobytes()
        with pytest.raises(native.BadFile):
            native.decode(junk)


def test_bands_stand_alone():
    image = noise(6, 300, 8, 16)
    for picture in (image, np.repeat(image[..., :1], 4, 2), np.dstack([image[..., :3], np.full((300, 6), 9, np.uint8)])):
        assert np.array_equal(native.decode(native.encode(picture, 9, 3, 42)), picture)


def test_contexts_pay():
    """Planes that are rough in the same places: states of the plane before tell where."""
    rng = np.random.default_rng(4)
    rough = (rng.random((60, 60)) < 0.1) * rng.integers(-40, 40, (60, 60))
    image = np.stack([100 + rough, 120 + rough, 140 - rough, np.full((60, 60), 255)], 2).astype(np.uint8)
    sizes = {m: len(native.encode(image, 0, 0, m)) for m in (0, 37, 45, 52, 53)}
    assert max(sizes[m] for m in (45, 52, 53)) < min(sizes[0], sizes[37])


def test_weighted_predictor_follows_a_slope():
    guess, wrong = native.WeightedPredictor(20), []
    plane = [[3 * x + 2 * y for x in range(20)] for y in range(20)]
    for y in range(20):
        for x in range(20):
            W, N, NW, NE, _, NN = native.around(plane, y, x, 128)
            wrong.append(abs(guess(x, y, W, N, NW, NE, NN) - plane[y][x]))
            guess.update(x, y, plane[y][x])
    assert sum(wrong[200:]) / 200 < 2


def test_depth_grids():
    for bits in range(1, 8):
        m = (1 << bits) - 1
        values = (np.arange(64).reshape(8, 8) % (m + 1) * 255 + m // 2) // m
        image = np.stack([values, values[::-1], values.T, np.full((8, 8), 255)], 2).astype(np.uint8)
        assert native.grid_depth(image[..., :3]) <= bits
        data = native.encode(image, reduce=True)
        assert data[13] >> 2 == native.grid_depth(image[..., :3]) and np.array_equal(native.decode(data), image)


def mixture_image():
    y, x = np.mgrid[:20, :70]
    v = np.stack([3 * x + 2 * y, (x // 9) * 30 + y, 255 - 2 * x, np.full_like(x, 255)], 2)
    return (v & 255).astype(np.uint8)


@pytest.mark.parametrize("layout", regions.SIZES)
def test_region_programs(layout):
    for image in (mixture_image(), fill(18, 17, 5), noise(16, 3)[..., :1].repeat(4, 2), fill(1, 1, 0), fill(1, 20, 2), fill(20, 1, 2)):
        data = codec.container(image.shape[1], image.shape[0], codec.BLOCKS, 0, regions.SIZES[layout], 0, regions.encode(image, layout))
        assert np.array_equal(codec.decode(data), image)
    data = regions.encode(mixture_image(), layout)
    assert len(data) < 20 * 70 * 3
    for i in range(20):
        with pytest.raises(regions.BadFile):
            regions.decode(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :], 70, 20)


def test_region_operations_are_all_read():
    """Every operation and coordinate, chosen at random, against residuals made for it."""
    rng, image = np.random.default_rng(5), mixture_image()
    planes = [image[..., c].astype(int).tolist() for c in range(3)]
    table, rest = bytearray(), np.zeros((20, 70, 3), int)
    seen = set()
    for y0 in range(0, 20, 16):
        for x0 in range(0, 70, 16):
            w, h = min(16, 70 - x0), min(16, 20 - y0)
            op = int(rng.choice([o for o in range(7) if not (o == regions.LEFT and x0 < 16) and not (o == regions.UP and y0 < 16)]))
            params = rng.integers(0, 256, regions.parameters(op, 3)).astype(np.uint8).tobytes()
            seen.add(op)
            table += bytes([op]) + params
            for c in range(3):
                guess = regions.predictor(b"QBL2", op, params, planes, c, x0, y0, w, h)
                for y in range(y0, y0 + h):
                    for x in range(x0, x0 + w):
                        rest[y, x, c] = planes[c][y][x] - guess(x, y)
    folded = np.dstack([regions.fold(rest), np.full((20, 70), 255)]).astype(np.uint8)
    stream = native.encode(folded, channels=3)
    data = b"QBL2" + bytes([16, 3, 0, 0]) + len(table).to_bytes(4, "little") + len(stream).to_bytes(8, "little") + bytes(table) + stream
    assert len(seen) > 4 and np.array_equal(regions.decode(data, 70, 20), image)


@pytest.mark.parametrize("model", range(9))
def test_tile_models(model):
    for image in (mixture_image()[..., :3], fill(9, 13, 4), fill(1, 1, 0), fill(1, 9, 2)[..., :1], fill(12, 1, 2)):
        h, w, channels = image.shape
        kind, data = tile_models.encode_tile(image, codec.filter_lines, (model,))
        assert kind == model and np.array_equal(tile_models.decode_tile(model, data, w, h, channels, codec.unfilter_lines), image)


def test_tile_models_in_bands(monkeypatch):
    monkeypatch.setattr(codec, "TILE", 7)
    for image in (mixture_image(), fill(11, 15, 3), np.repeat(noise(9, 10, 2, 16)[..., :1], 4, 2)):
        data = dict(codec.candidates(image, ("tile-models",)))["tile-models"]
        assert np.array_equal(codec.decode(data), image)
    plane = (np.mgrid[:20, :30][1] * 8)[..., None].repeat(4, 2).astype(np.uint8)
    plane[..., 3] = 255
    least = {m: len(tile_models.encode_tile(plane[..., :1], codec.filter_lines, (m,))[1]) for m in range(9)}
    assert len(tile_models.encode_tile(plane[..., :1], codec.filter_lines)[1]) == min(least.values())


def frame_kinds(data):
    payload, at, kinds = data[28:-4], 12, []
    for _ in range(int.from_bytes(payload[4:8], "little")):
        kind = int.from_bytes(payload[at + 4 : at + 8], "little")
        kinds.append(kind)
        at += 8
        if kind == codec.MOVE:
            at += 28
        elif kind != codec.DUPLICATE:
            at += 16 * (kind == codec.RECTANGLE)
            at += 8 + int.from_bytes(payload[at : at + 8], "little")
    return kinds


@pytest.mark.parametrize("shift", [(42, 34), (5, 3), (-7, 0), (0, 9)])
def test_a_moved_sprite_is_a_move(shift):
    sprite = noise(24, 20, 9)
    frames = []
    for x, y in ((31, 33), (31 + shift[0], 33 + shift[1])):
        frame = np.full((96, 128, 4), (18, 24, 31, 255), np.uint8)
        frame[y : y + 20, x : x + 24] = sprite
        frames.append(frame)
    data = codec.encode_animation(frames, [17, 29], 0, ("palette", "raw"))
    assert frame_kinds(data) == [codec.KEY, codec.MOVE]
    got, delays, _ = codec.decode_animation(data)
    assert all(map(np.array_equal, got, frames)) and delays == [17, 29]
    frames[1][90, 3] = 1
    data = codec.encode_animation(frames, [17, 29], 0, ("palette", "raw"))
    assert codec.MOVE not in frame_kinds(data) and all(map(np.array_equal, codec.decode_animation(data)[0], frames))
