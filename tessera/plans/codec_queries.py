"""Queries over coded files: headers, checksums, candidates and round trips. Coding has no SQL; where what must hold of the result has, it is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import files, raster

HEIGHT = 32


def _images(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """Images of 16 by 32 from the embeddings."""
    rows = raster.rgba(spark, sf_dir, shift).withColumn("img", F.expr(f"y div {HEIGHT}"))
    return files.images(rows, "img").withColumn("image_id", F.col("img").cast("string")).drop("img")


def _round_trip(families: tuple[str, ...], shift: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        images = _images(spark, sf_dir, shift)
        made = files.encoded(images, families)
        back = files.decoded(made).select("image_id", "status", F.col("rgba").alias("got"))
        joined = images.join(made, "image_id").join(back, "image_id")
        return joined.select("image_id", "kind", F.length("content").alias("bytes"), "status", (F.col("rgba") == F.col("got")).alias("exact"))

    return query


def header_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = files.encoded(_images(spark, sf_dir, 5))
    return files.headers(made).select("image_id", "width", "height", "mode", "transform", "bits", "count", "payload", "animated", "frames", "status")


def crc_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as they are and with a bit of the last byte of the body changed: which are found sound."""
    made = files.encoded(_images(spark, sf_dir, 5), ("raw",))
    body = F.length("content") - 5
    last = F.unhex(F.lpad(F.hex(files.number("content", 0, 1) * 0 + F.conv(F.hex(F.substring("content", body + 1, F.lit(1))), 16, 10).cast("long").bitwiseXOR(64)), 2, "0"))
    bad = made.withColumn("content", F.concat(F.substring("content", F.lit(1), body), last, F.substring("content", -4, 4)))
    both = made.withColumn("changed", F.lit(False)).unionByName(bad.withColumn("changed", F.lit(True)))
    return files.headers(both).groupBy("changed", "crc_ok", "status").agg(F.count("*").alias("n"))


def candidate_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winner of each image from the table of its candidates."""
    return files.winners(files.all_candidates(_images(spark, sf_dir, 6)))


def native_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each mode, transform and tile size makes the smallest native stream."""
    best = files.winners(files.native_trials(_images(spark, sf_dir, 4)))
    return best.groupBy("kind").agg(F.count("*").alias("images"), F.sum("bytes").alias("bytes"))


def roundtrip_anim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames, in sequences of at most 8; a frame with fewer lines begins one of its own, as a sequence has one size."""
    rows = raster.rgba(spark, sf_dir, 6).withColumn("frame", F.expr(f"y div {HEIGHT}"))
    still = "CASE WHEN frame % 4 = 3 OR (y % 32 < 20) THEN transform({c}, v -> 1) ELSE {c} END"
    frames = files.images(rows.select("frame", "y", *(F.expr(still.format(c=c)).alias(c) for c in "rgba")), "frame")
    frames = frames.withColumn("anim", F.expr(f"CAST(frame div 8 * {HEIGHT} + {HEIGHT} - height AS BIGINT)"))
    frames = frames.withColumn("frame", F.expr("CAST(row_number() OVER (PARTITION BY anim ORDER BY frame) - 1 AS BIGINT)")).withColumn("delay", F.expr("frame * 10"))
    back = files.decoded_sequences(files.encoded_sequences(frames)).select("anim", "frame", F.col("delay").alias("got_delay"), F.col("rgba").alias("got"))
    joined = frames.join(back, ["anim", "frame"], "left")
    return joined.select("anim", "frame", "got_delay", F.coalesce(F.col("rgba") == F.col("got"), F.lit(False)).alias("exact"))


def picture_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG and BMP files of the images: the format their bytes tell, and whether reading gives the pixels back."""
    images = _images(spark, sf_dir, 4)
    made = files.pictures(images, "png").withColumn("written", F.lit("png")).unionByName(files.pictures(images, "bmp").withColumn("written", F.lit("bmp")))
    made = made.withColumns({"format": files.sniffed(), "key": F.col("image_id"), "image_id": F.concat("image_id", F.lit("."), "written")})
    back = files.decoded(made).select("image_id", "status", F.col("rgba").alias("got"))
    joined = made.join(back, "image_id").join(images.select(F.col("image_id").alias("key"), "rgba"), "key")
    return joined.groupBy("written", "format", "status").agg(F.count("*").alias("files"), F.count_if(F.col("rgba") == F.col("got")).alias("exact"))


#: Families of coding and the low bits that their test images go without.
FAMILIES = {"raw": 0, "filtered": 0, "rle": 6, "palette": 6, "blocks": 7, "native": 4}


def coded_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each family by itself: files it makes of the images, those that are read back exactly, and their pixels."""
    out = None
    for family, shift in FAMILIES.items():
        images = _images(spark, sf_dir, shift)
        back = files.decoded(files.encoded(images, (family,))).select("image_id", "status", F.col("rgba").alias("got"))
        joined = images.join(back, "image_id", "left")
        exact = F.coalesce((F.col("status") == "ok") & (F.col("rgba") == F.col("got")), F.lit(False))
        one = joined.agg(F.lit(family).alias("family"), F.count("*").alias("images"), F.count_if(exact).alias("exact"), F.sum(F.length("got") / 4).cast("long").alias("pixels"))
        out = one if out is None else out.unionByName(one)
    return out


def header_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and states by the headers of the smallest files."""
    return header_scan(spark, sf_dir).select("image_id", "width", "height", "animated", "status")


_SIZES = f"SELECT CAST(vec_id // {HEIGHT} AS VARCHAR) AS image_id, CAST(count(*) AS INT) AS lines FROM embeddings GROUP BY vec_id // {HEIGHT}"
CODED_EXACT = "\nUNION ALL ".join(f"SELECT '{family}' AS family, count(*) AS images, count(*) AS exact, CAST(sum(16 * lines) AS BIGINT) AS pixels FROM ({_SIZES})" for family in FAMILIES)
HEADER_SIZES = f"SELECT image_id, 16 AS width, lines AS height, false AS animated, 'ok' AS status FROM ({_SIZES})"
CRC_CHECK = f"SELECT changed, NOT changed AS crc_ok, CASE WHEN changed THEN 'checksum differs' ELSE 'ok' END AS status, count(*) AS n FROM ({_SIZES}), (SELECT unnest([false, true]) AS changed) GROUP BY ALL"
PICTURE_FORMATS = f"SELECT written, written AS format, 'ok' AS status, count(*) AS files, count(*) AS exact FROM ({_SIZES}), (SELECT unnest(['png', 'bmp']) AS written) GROUP BY ALL"
#: Sequences of eight frames; one of fewer lines is a sequence of its own.
ROUNDTRIP_ANIM = f"""
WITH f AS (SELECT vec_id // {HEIGHT} AS frame, count(*) AS height FROM embeddings GROUP BY ALL),
a AS (SELECT frame // 8 * {HEIGHT} + {HEIGHT} - height AS anim, row_number() OVER (PARTITION BY frame // 8 * {HEIGHT} + {HEIGHT} - height ORDER BY frame) - 1 AS frame FROM f)
SELECT anim, frame, CASE WHEN frame = 0 THEN 100 ELSE 10 * frame END AS got_delay, true AS exact FROM a"""
#: Samples without order leave nothing to gain: 32 bytes of header and the samples as they are.
ROUNDTRIP_RAW = f"SELECT image_id, 'raw' AS kind, 32 + 64 * lines AS bytes, 'ok' AS status, true AS exact FROM ({_SIZES})"

QUERIES = {
    "coded_exact": coded_exact, "header_sizes": header_sizes,
    "header_scan": header_scan, "crc_check": crc_check, "candidate_sizes": candidate_sizes, "native_trials": native_trials, "roundtrip_raw": _round_trip(("raw", "rle", "filtered"), 0),
    "roundtrip_palette": _round_trip(("palette",), 6), "roundtrip_blocks": _round_trip(("blocks",), 7), "roundtrip_native": _round_trip(("native",), 0),
    "roundtrip_anim": roundtrip_anim, "picture_formats": picture_formats,
}
ORACLES: dict[str, str] = {
    "coded_exact": CODED_EXACT, "header_sizes": HEADER_SIZES, "crc_check": CRC_CHECK, "picture_formats": PICTURE_FORMATS, "roundtrip_anim": ROUNDTRIP_ANIM, "roundtrip_raw": ROUNDTRIP_RAW,
}
