"""Image files as DataFrames: scanning, sniffing, header fields, decoding, encoding and writing.

Headers are read with binary expressions in the JVM; only decoding and encoding run in Python, a few records at a time.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import codec, native

#: First bytes of formats; in their order, so that a longer mark comes first.
MARKS = [("png", 1, "89504E470D0A1A0A"), ("container", 1, "514C4943"), ("jxl", 1, "0000000C4A584C20"), ("jxl", 1, "FF0A"), ("jpeg", 1, "FFD8FF"), ("tiff", 1, "49492A00"), ("tiff", 1, "4D4D002A"), ("tiff", 1, "49492B00"), ("bmp", 1, "424D"), ("gif", 1, "47494638")]
STATUS = "status string, image_id string, width int, height int, rgba binary"


def scan(spark: SparkSession, path: str, *, pattern: str = "*", recursive: bool = True, most: int = codec.MAX_FILE) -> DataFrame:
    """path, length and content of files that aren't empty or over the limit; the limit is checked before contents are read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return reader.load(path).filter((F.col("length") > 0) & (F.col("length") <= most)).select("path", "length", "content")


def number(content: str, at: int, size: int, big: bool = False) -> Column:
    """Unsigned number of `size` bytes from byte `at` on (0 is the first; a negative place counts from the end)."""
    return _unsigned(F.substring(F.col(content), at + 1 if at >= 0 else at, size), size, big)


def _unsigned(part: Column, size: int, big: bool = False) -> Column:
    """Bytes are put in order as hexadecimal digits: reverse() takes binary for text and keeps bytes together that look like one character."""
    digits = F.hex(part)
    ordered = digits if big or size == 1 else F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in range(size - 1, -1, -1)))
    return F.conv(ordered, 16, 10).cast("long")


def sniffed(content: str = "content") -> Column:
    """The format that a file's first bytes tell."""
    at = lambda start, mark: F.substring(F.col(content), start, len(mark) // 2) == F.unhex(F.lit(mark))
    webp, avif = at(1, "52494646") & at(9, "57454250"), at(5, "6674797061766966") | at(5, "6674797061766973")
    out = F.when(webp, "webp").when(avif, "avif")
    for name, start, mark in MARKS:
        out = out.when(at(start, mark), name)
    return out.otherwise("unknown")


def png_model(content: str = "content") -> Column:
    """Colour model by the type byte of a PNG header."""
    kind = number(content, 25, 1)
    return F.when(sniffed(content) != "png", "unknown").when(kind == 2, "RGB").when(kind == 6, "RGBA").otherwise("unknown")


def headers(files: DataFrame) -> DataFrame:
    """files with the container header's fields, crc_ok and status; no pixel is decoded.

    status is ok, or the first rule that a header breaks: not a container, limit exceeded, invalid codec, invalid mode, checksum differs."""
    fields = {"width": number("content", 4, 4), "height": number("content", 8, 4), "mode": number("content", 12, 1), "transform": number("content", 13, 1), "bits": number("content", 14, 1), "packed": number("content", 15, 1), "count": number("content", 16, 4), "payload": number("content", 20, 8)}
    table = files.withColumns(fields)
    size = F.length("content")
    crc = F.crc32(F.substring("content", F.lit(1), F.greatest(size - 4, F.lit(0)))) == number("content", -4, 4)
    status = (
        F.when((sniffed() != "container") | (size < 32), "not a container")
        .when((F.col("width") == 0) | (F.col("height") == 0) | (F.col("width").cast("decimal(20,0)") * F.col("height") > codec.MAX_PIXELS) | (F.col("payload") > codec.MAX_PAYLOAD), "limit exceeded")
        .when((F.col("packed").bitwiseAND(128) == 0) | (F.col("packed").bitwiseAND(0x7C) != 0) | F.col("packed").bitwiseAND(3).isin(1, 2), "invalid codec")
        .when(~F.col("mode").isin([*range(1, 6), 7, *range(9, 19)]) | (F.col("transform") > 10), "invalid mode")
        .when(~crc, "checksum differs")
        .otherwise("ok")
    )
    animated = F.col("mode") == codec.ANIM
    return table.withColumns({"crc_ok": crc, "status": status, "animated": animated, "frames": F.when(animated, F.col("count")).otherwise(1)})


def native_headers(streams: DataFrame) -> DataFrame:
    """streams (content) with the native stream header's fields."""
    n = lambda at, size: number("content", at, size)
    flags = n(13, 1)
    return streams.withColumns(
        {
            "width": n(4, 4), "height": n(8, 4), "channels": n(12, 1), "is_gray": flags.bitwiseAND(1) == 1, "constant_alpha": flags.bitwiseAND(2) == 2,
            "sample_bits": F.shiftright(flags, 2), "mode": n(14, 1), "transform": n(15, 1), "tile_log": n(16, 1), "control": n(17, 1), "pixel_crc": n(18, 4), "payload": n(22, 4),
        }
    )


def images(rows: DataFrame, *keys: str) -> DataFrame:
    """A record per image of a colour row relation: keys, width, height, rgba (binary), put together in the JVM."""
    cells = F.array_sort(F.collect_list(F.struct("y", F.arrays_zip("r", "g", "b", "a").alias("p"))))
    whole = rows.groupBy(*keys).agg(cells.alias("lines"))
    hex_ = F.array_join(F.transform(F.flatten(F.transform("lines", lambda s: s["p"])), lambda p: F.concat(*(F.lpad(F.hex(p[c]), 2, "0") for c in "rgba"))), "")
    return whole.select(*keys, F.size(F.expr("lines[0].p")).alias("width"), F.size("lines").alias("height"), F.unhex(hex_).alias("rgba"))


def encoded(images: DataFrame, families: tuple[str, ...] | None = None) -> DataFrame:
    """image_id, kind and content: the smallest container of each image. images: image_id, width, height, rgba."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [codec.encode(np.frombuffer(p, np.uint8).reshape(h, w, 4), families) for w, h, p in zip(batch.width, batch.height, batch.rgba)]
            yield pd.DataFrame({"image_id": batch.image_id, "kind": [k for k, _ in made], "content": [c for _, c in made]})

    return images.select(F.col("image_id").cast("string").alias("image_id"), "width", "height", "rgba").mapInPandas(task, "image_id string, kind string, content binary")


def all_candidates(images: DataFrame) -> DataFrame:
    """image_id, place, kind and bytes of every candidate: the table from which the winner is the least (bytes, place)."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, w, h, p in zip(batch.image_id, batch.width, batch.height, batch.rgba):
                made = list(codec.candidates(np.frombuffer(p, np.uint8).reshape(h, w, 4)))
                yield pd.DataFrame({"image_id": name, "place": range(len(made)), "kind": [k for k, _ in made], "bytes": [len(c) for _, c in made]})

    return images.select(F.col("image_id").cast("string").alias("image_id"), "width", "height", "rgba").mapInPandas(task, "image_id string, place int, kind string, bytes long")


#: Mode, transform, tile size (as a power of two) that native trials try, in the order that settles ties.
TRIALS = [(0, 2, 0), (3, 9, 3), (27, 5, 3), (36, 5, 4), (38, 2, 0), (39, 1, 0), (40, 0, 0), (1, 0, 0), (37, 9, 3), (45, 5, 0), (53, 5, 3)]


def native_trials(images: DataFrame, trials: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """image_id, place, kind (mode/transform/tile) and bytes: every image under every trial, each a row and so a unit of work of its own. Trials
    that don't suit an image have no row. `winners` gives the smallest."""
    table = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(m).alias("mode"), F.lit(t).alias("transform"), F.lit(log).alias("tile")) for i, (m, t, log) in enumerate(trials or TRIALS)))
    rows = images.select(F.col("image_id").cast("string").alias("image_id"), "width", "height", "rgba", F.explode(table).alias("t")).select("image_id", "width", "height", "rgba", "t.*")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, w, h, p, place, mode, transform, tile in b.itertuples(index=False):
                try:
                    size = len(native.encode(np.frombuffer(p, np.uint8).reshape(h, w, 4), transform, tile, mode, reduce=True))
                except codec.BadFile:
                    continue
                out.append((name, place, f"{mode}/{transform}/{tile}", size))
            yield pd.DataFrame(out, columns=["image_id", "place", "kind", "bytes"])

    return rows.repartition(F.col("image_id"), F.col("place")).mapInPandas(task, "image_id string, place int, kind string, bytes long")


def winners(candidates: DataFrame) -> DataFrame:
    """The smallest candidate of each image, the first of equals."""
    return candidates.groupBy("image_id").agg(F.min(F.struct("bytes", "place", "kind")).alias("m")).select("image_id", F.col("m.kind").alias("kind"), F.col("m.bytes").alias("bytes"))


def decoded(files: DataFrame) -> DataFrame:
    """status, image_id, width, height, rgba. files: image_id and content. A bad file has its reason as status and nulls, and fails nothing else."""

    def one(data: bytes) -> tuple:
        try:
            image = read_picture(data)
        except codec.BadFile as e:
            return str(e), None, None, None
        return "ok", image.shape[1], image.shape[0], image.tobytes()

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [one(bytes(c)) for c in batch.content]
            table = pd.DataFrame(got, columns=["status", "width", "height", "rgba"]).assign(image_id=batch.image_id.values)
            yield table.astype({"width": "Int32", "height": "Int32"})[["status", "image_id", "width", "height", "rgba"]]

    return files.select("image_id", "content").mapInPandas(task, STATUS)


def read_picture(data: bytes) -> np.ndarray:
    """Pixels of a container, PNG or BMP file; other and lossy formats are refused."""
    if data[:4] == codec.MARK:
        return codec.decode(data)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return read_png(data)
    if data[:2] == b"BM":
        return read_bmp(data)
    raise codec.BadFile("the format is not supported")


def read_png(data: bytes) -> np.ndarray:
    """PNG of at most 8 bits, not interlaced, of any colour type."""
    at, parts, palette, clear, head = 8, [], None, b"", None
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) != size or zlib.crc32(kind + body) != struct.unpack_from(">I", data.ljust(at + 12 + size, b"\0"), at + 8 + size)[0]:
            raise codec.BadFile("a PNG chunk is damaged")
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">II5B", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
    if head is None or head[2] > 8 or head[6] or not head[0] or not head[1] or head[0] * head[1] > codec.MAX_PIXELS:
        raise codec.BadFile("PNG of this kind is not supported")
    w, h, bits, kind = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if channels is None:
        raise codec.BadFile("no such PNG colour type")
    line = -(-w * channels * bits // 8)
    unpack = zlib.decompressobj()
    try:
        raw = unpack.decompress(b"".join(parts), (line + 1) * h)
    except zlib.error as e:
        raise codec.BadFile("PNG data is damaged") from e
    step = max(1, channels * bits // 8)
    lines = codec.unfilter_lines(raw, line, h, step)  # filters 0 to 4 are the same
    if (np.frombuffer(raw, np.uint8).reshape(h, line + 1)[:, 0] > 4).any():
        raise codec.BadFile("no such PNG filter")
    if bits < 8:
        cells = np.unpackbits(lines, axis=1)[:, : w * bits].reshape(h, w, bits)
        values = (cells << np.arange(bits - 1, -1, -1)).sum(2).astype(np.uint8)[..., None]
        v = values if kind == 3 else (values.astype(int) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    else:
        values = v = lines.reshape(h, w, channels)
    out = np.full((h, w, 4), 255, np.uint8)
    if kind == 3:
        if palette is None or values.max(initial=0) >= len(palette):
            raise codec.BadFile("a PNG index is out of range")
        out[..., :3] = palette[values[..., 0]]
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        out[..., 3] = alpha[values[..., 0]]
        return out
    out[..., :3] = v[..., :1] if channels < 3 else v[..., :3]
    if channels in (2, 4):
        out[..., 3] = v[..., -1]
    elif clear:
        key = np.array(struct.unpack(f">{len(clear) // 2}H", clear))
        out[(values == key).all(2), 3] = 0
    return out


def read_bmp(data: bytes) -> np.ndarray:
    """BMP of 1, 4, 8, 24 or 32 bits, with runs or without; 32 bits with no alpha anywhere are opaque."""
    if len(data) < 54:
        raise codec.BadFile("BMP is cut off")
    start, size, w, h, planes, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    top_down, h = h < 0, abs(h)
    if size < 40 or planes != 1 or w <= 0 or not h or w * h > codec.MAX_PIXELS or (bits, packing) not in {(1, 0), (4, 0), (8, 0), (24, 0), (32, 0), (32, 3), (8, 1), (4, 2)}:
        raise codec.BadFile("BMP of this kind is not supported")
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << min(bits, 8)
    palette = np.frombuffer(data[14 + size : 14 + size + 4 * colours].ljust(4 * 256, b"\0")[: 4 * 256], np.uint8).reshape(-1, 4)
    out = np.full((h, w, 4), 255, np.uint8)
    if packing in (1, 2):
        ids = _bmp_runs(data[start:], w, h, bits)
    else:
        line = -(-w * bits // 32) * 4
        body = np.frombuffer(data[start : start + line * h], np.uint8)
        if len(body) != line * h:
            raise codec.BadFile("BMP is cut off")
        lines = body.reshape(h, line)
        if bits >= 24:
            p = lines[:, : w * bits // 8].reshape(h, w, bits // 8)
            out[..., :3] = p[..., 2::-1]
            if bits == 32 and p[..., 3].any():
                out[..., 3] = p[..., 3]
            return out if top_down else out[::-1]
        cells = np.unpackbits(lines, axis=1)[:, : w * bits].reshape(h, w, bits)
        ids = (cells << np.arange(bits - 1, -1, -1)).sum(2)
    out[..., :3] = palette[ids][..., 2::-1]
    return out if top_down else out[::-1]


def _bmp_runs(data: bytes, w: int, h: int, bits: int) -> np.ndarray:
    ids, x, y, at = np.zeros((h, w), int), 0, 0, 0
    while at + 1 < len(data):
        n, v = data[at], data[at + 1]
        at += 2
        if n == 0 and v == 0:
            x, y = 0, y + 1
        elif n == 0 and v == 1:
            return ids
        elif n == 0 and v == 2:
            if at + 1 >= len(data):
                break
            x, y, at = x + data[at], y + data[at + 1], at + 2
        else:
            count = n or v
            taken = 0 if n else -(-v * bits // 8)
            body = data[at : at + taken] if not n else bytes([v]) * count
            values = list(body) if bits == 8 else [b >> s & 15 for b in body for s in (4, 0)]
            at += taken + (taken & 1)
            if y >= h or x + count > w or len(values) < count:
                raise codec.BadFile("a BMP run leaves the image")
            ids[y, x : x + count] = values[:count]
            x += count
    raise codec.BadFile("BMP runs are cut off")


def png(rgba: np.ndarray) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w = rgba.shape[:2]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rgba.reshape(h, -1)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II5B", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def bmp(rgba: np.ndarray) -> bytes:
    h, w = rgba.shape[:2]
    body = np.ascontiguousarray(rgba[::-1][..., [2, 1, 0, 3]]).tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 32, 0, len(body), 2835, 2835, 0, 0) + body


def ppm(rgba: np.ndarray) -> bytes:
    """Binary PPM; an image that isn't opaque is refused."""
    if (rgba[..., 3] != 255).any():
        raise codec.BadFile("PPM has no alpha")
    return f"P6\n{rgba.shape[1]} {rgba.shape[0]}\n255\n".encode() + np.ascontiguousarray(rgba[..., :3]).tobytes()


def pictures(images: DataFrame, kind: str = "png") -> DataFrame:
    """image_id and content: images (image_id, width, height, rgba) as PNG, BMP or PPM files."""
    make = {"png": png, "bmp": bmp, "ppm": ppm}[kind]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"image_id": b.image_id, "content": [make(np.frombuffer(p, np.uint8).reshape(h, w, 4)) for w, h, p in zip(b.width, b.height, b.rgba)]})

    return images.select("image_id", "width", "height", "rgba").mapInPandas(task, "image_id string, content binary")


def write(files: DataFrame, folder: str, ending: str) -> DataFrame:
    """Writes a file for each row (image_id, content) in a folder that all tasks share; returns path and bytes. A file appears whole, by renaming.

    Names that would meet are refused before anything is written."""
    twice = files.groupBy("image_id").agg(F.count("*").alias("n")).filter("n > 1")
    if not twice.isEmpty():
        raise ValueError("two rows would write one file")
    os.makedirs(folder, exist_ok=True)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            paths = []
            for name, content in zip(b.image_id, b.content):
                path = os.path.join(folder, f"{name}.{ending}")
                with open(part := f"{path}.{uuid.uuid4().hex}.tmp", "wb") as out:
                    out.write(content)
                os.replace(part, path)
                paths.append(path)
            yield pd.DataFrame({"path": paths, "bytes": [len(c) for c in b.content]})

    return files.select("image_id", "content").mapInPandas(task, "path string, bytes long")


def encoded_sequences(frames: DataFrame) -> DataFrame:
    """anim and content. frames: anim, frame, width, height, rgba, delay. A sequence is one group, since a frame is coded against the one before."""

    def one(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("frame")
        pixels = [np.frombuffer(p, np.uint8).reshape(h, w, 4) for w, h, p in zip(table.width, table.height, table.rgba)]
        content = codec.encode_animation(pixels, [int(d) for d in table.delay], 0, ("raw", "palette", "filtered"))
        return pd.DataFrame({"anim": [table.anim.iloc[0]], "content": [content]})

    return frames.groupBy("anim").applyInPandas(one, "anim long, content binary")


def decoded_sequences(files: DataFrame) -> DataFrame:
    """anim, frame, delay and rgba of every frame. files: anim, content."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for anim, content in zip(b.anim, b.content):
                frames, delays, _ = codec.decode_animation(bytes(content))
                yield pd.DataFrame({"anim": anim, "frame": range(len(frames)), "delay": delays, "rgba": [f.tobytes() for f in frames]})

    return files.select("anim", "content").mapInPandas(task, "anim long, frame long, delay long, rgba binary")
