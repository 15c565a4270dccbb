"""Files as DataFrames: sniffing, header rules, pictures, sinks; native headers against the kernel's own reader."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_codec import fill, noise, sequence

from tessera.operators import codec, native
from tessera.sources import files


def table(spark, **content):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in content.items()], "image_id string, content binary")


def test_headers_equal_the_kernel(spark):
    made = {f"{n}{i}": d for i, image in enumerate((fill(17, 19, 5), noise(300, 7, 2, 64), fill(1, 1, 0))) for n, d in codec.candidates(image)}
    got = files.headers(table(spark, **made)).collect()
    for r in got:
        h = codec.header(bytes(r.content))
        assert (r.width, r.height, r.mode, r.transform, r.bits, r["count"], r.payload, r.status, r.crc_ok) == (h.width, h.height, h.mode, h.transform, h.bits, h.count, h.payload, "ok", True)
    assert len(got) == len(made)


def test_header_rules(spark):
    good = codec.encode(fill(9, 9, 1), ("raw",))[1]
    cut, flip = good[:-1], good[:40] + bytes([good[40] ^ 1]) + good[41:]
    huge = codec.MARK + b"\xff" * 8 + good[12:]
    kinds = table(spark, good=good, cut=cut, flip=flip, huge=huge, text=b"hello", codec_=good[:15] + b"\x81" + good[16:], mode=good[:12] + b"\x06" + good[13:], anim=codec.encode_animation(*sequence(), 3, ("raw",)))
    got = {r.image_id: (r.status, r.frames) for r in files.headers(kinds).collect()}
    assert got == {"good": ("ok", 1), "cut": ("checksum differs", 1), "flip": ("checksum differs", 1), "huge": ("limit exceeded", 1), "text": ("not a container", 1), "codec_": ("invalid codec", 1), "mode": ("invalid mode", 1), "anim": ("ok", 4)}


def test_native_headers(spark):
    data = native.encode(fill(30, 20, 2), 7, 3, 3)
    r = files.native_headers(table(spark, a=data)).first()
    assert (r.width, r.height, r.channels, r.mode, r.transform, r.tile_log, r.payload, r.is_gray, r.sample_bits) == (30, 20, 4, 3, 7, 3, len(data) - 30, False, 0)


def test_formats_and_decoding(spark):
    image = fill(20, 11, 4)
    rows = dict(png=files.png(image), bmp=files.bmp(image), own=codec.encode(image)[1], jpg=b"\xff\xd8\xff\xe0 lossy", webp=b"RIFF0000WEBPVP8 ", avif=b"0000ftypavif", tiff=b"II*\0....", none=b"")
    got = {r.image_id: r for r in files.decoded(table(spark, **rows)).collect()}
    assert all(got[k].status == "ok" and bytes(got[k].rgba) == image.tobytes() for k in ("png", "bmp", "own"))
    assert all(got[k].status != "ok" and got[k].rgba is None for k in ("jpg", "webp", "avif", "tiff", "none"))
    kinds = {r.image_id: r.f for r in table(spark, **rows).select("image_id", files.sniffed().alias("f")).collect()}
    assert kinds == {"png": "png", "bmp": "bmp", "own": "container", "jpg": "jpeg", "webp": "webp", "avif": "avif", "tiff": "tiff", "none": "unknown"}


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def test_png_kinds():
    for kind, bits, extra, line, want in (
        (3, 2, chunk(b"PLTE", bytes(range(12))) + chunk(b"tRNS", b"\x07"), [0b00011011], [[0, 1, 2, 7], [3, 4, 5, 255], [6, 7, 8, 255], [9, 10, 11, 255]]),
        (0, 4, b"", [0x0F, 0x50], [[0, 0, 0, 255], [255, 255, 255, 255], [85, 85, 85, 255], [0, 0, 0, 255]]),
        (4, 8, b"", [1, 2, 3, 4, 5, 6, 7, 8], [[1, 1, 1, 2], [3, 3, 3, 4], [5, 5, 5, 6], [7, 7, 7, 8]]),
        (2, 8, chunk(b"tRNS", struct.pack(">3H", 1, 2, 3)), [1, 2, 3, 9, 9, 9, 0, 0, 0, 4, 5, 6], [[1, 2, 3, 0], [9, 9, 9, 255], [0, 0, 0, 255], [4, 5, 6, 255]]),
    ):
        data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II5B", 4, 1, bits, kind, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(bytes([0, *line]))) + chunk(b"IEND", b"")
        assert files.read_png(data)[0].tolist() == want
    deep = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II5B", 4, 1, 16, 2, 0, 0, 0))
    with pytest.raises(codec.BadFile):
        files.read_png(deep)


def test_bmp_kinds():
    def head(w, h, bits, packing, body, palette):
        return b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + len(palette)) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, packing, len(body), 0, 0, len(palette) // 4, 0) + palette + body

    palette = bytes([10, 20, 30, 0, 1, 2, 3, 0])
    a, b = [30, 20, 10, 255], [3, 2, 1, 255]
    assert files.read_bmp(head(3, -1, 1, 0, bytes([0b01000000, 0, 0, 0]), palette))[0].tolist() == [a, b, a]
    assert files.read_bmp(head(3, 2, 8, 1, bytes([3, 1, 0, 0, 1, 0, 2, 1, 0, 1]), palette)).tolist() == [[a, b, b], [b, b, b]]
    assert files.read_bmp(head(4, 1, 4, 2, bytes([0, 3, 0x01, 0x00, 1, 0x10, 0, 1]), palette))[0].tolist() == [a, b, a, b]
    with pytest.raises(codec.BadFile):
        files.read_bmp(head(2, 1, 8, 1, bytes([5, 1]), palette))


def test_sinks_and_scan(spark, tmp_path):
    image = fill(8, 6, 1)
    images = spark.createDataFrame([("a", 8, 6, bytearray(image.tobytes())), ("b", 6, 8, bytearray(image.tobytes()))], "image_id string, width int, height int, rgba binary")
    files.write(files.pictures(images), str(tmp_path), "png").collect()
    (tmp_path / "empty.png").touch()
    found = files.scan(spark, str(tmp_path), pattern="*.png")
    assert found.count() == 2 and {r[0] for r in found.select(files.png_model()).collect()} == {"RGBA"}
    with pytest.raises(ValueError):
        files.write(table(spark, a=b"1").union(table(spark, a=b"2")), str(tmp_path), "x")
    assert files.ppm(np.full((2, 1, 4), 255, np.uint8)) == b"P6\n1 2\n255\n" + b"\xff" * 6
    with pytest.raises(codec.BadFile):
        files.ppm(image)


def test_winner_is_the_smallest_candidate(spark):
    images = spark.createDataFrame([("a", 73, 61, bytearray(fill(73, 61, 3).tobytes())), ("b", 40, 30, bytearray(noise(40, 30, 3, 128).tobytes()))], "image_id string, width int, height int, rgba binary")
    best = {r.image_id: (r.kind, r.bytes) for r in files.winners(files.all_candidates(images)).collect()}
    made = {r.image_id: (r.kind, len(r.content)) for r in files.encoded(images).collect()}
    assert best == made


def test_sequences_by_key(spark):
    frames, delays = sequence()
    rows = [(a, i, 64, 48, bytearray(f.tobytes()), d) for a in (1, 2) for i, (f, d) in enumerate(zip(frames, delays))]
    table_ = spark.createDataFrame(rows, "anim long, frame long, width int, height int, rgba binary, delay long")
    back = {(r.anim, r.frame): (bytes(r.rgba), r.delay) for r in files.decoded_sequences(files.encoded_sequences(table_)).collect()}
    assert back == {(r[0], r[1]): (bytes(r[4]), r[5] or 100) for r in rows}
    assert table_.filter(F.col("anim") > 5).count() == 0


def test_native_trials_find_the_smallest(spark):
    pictures = {"a": fill(20, 15, 3), "b": noise(18, 12, 3, 128)}
    images = spark.createDataFrame([(k, p.shape[1], p.shape[0], bytearray(p.tobytes())) for k, p in pictures.items()], "image_id string, width int, height int, rgba binary")
    best = {r.image_id: r.bytes for r in files.winners(files.native_trials(images)).collect()}
    for k, p in pictures.items():
        sizes = []
        for mode, transform, tile in files.TRIALS:
            try:
                sizes.append(len(native.encode(p, transform, tile, mode, reduce=True)))
            except codec.BadFile:
                continue
        assert best[k] == min(sizes)
