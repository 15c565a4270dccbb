"""Preparing a corpus and comparing codecs over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_of_each(files: DataFrame, content: str, *order: str) -> DataFrame:
    """files with digest (SHA-256 of `content`), first and copies: the first file of each content in `order` is kept, as `first` tells.

    The least file of a digest is found by an aggregate, which adds up before the exchange; a digest that very many files share is
    then a join key that Spark can split."""
    table = files.withColumn("digest", F.sha2(F.col(content).cast("binary"), 256))
    key = F.struct(*order)
    least = table.groupBy("digest").agg(F.min(key).alias("_least"), F.count("*").alias("copies"))
    return table.join(least, "digest").withColumn("first", key == F.col("_least")).drop("_least")


def exclusion(width: Column, height: Column, most: int = 16_383, pixels: int = 16_000_000, failed: Column | None = None) -> Column:
    """Why an image of this size is left out, or null. failed: what a tool said that could not read it, null where it could."""
    first = F.when(failed.isNotNull(), F.concat(F.lit("tool failure: "), failed)) if failed is not None else F
    return first.when((width > most) | (height > most), F.lit("dimension limit")).when(width.cast("long") * height > pixels, F.lit("pixel ceiling"))


def manifest(files: DataFrame) -> DataFrame:
    """A row for each image that a corpus keeps. files: path, category, width, height, opaque, digest, source."""
    model = F.when(F.col("opaque"), "RGB").otherwise("RGBA")
    pixels = F.col("width").cast("long") * F.col("height")
    return files.select(
        F.col("path").alias("Path"), F.col("category").alias("Category"), F.col("width").alias("Width"), F.col("height").alias("Height"), pixels.alias("Pixels"),
        model.alias("ColorModel"), F.col("digest").alias("NormalizedSHA256"), F.col("source").alias("Source"),
    )


def missing(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of a manifest whose file isn't there. files: path."""
    return listed.join(files.select(F.col("path").alias("Path")), "Path", "left_anti")


def first_images(files: DataFrame, n: int) -> DataFrame:
    """The first n by path; every task gives n at most to the last one."""
    return files.orderBy("path").limit(n)


def in_report_order(rows: DataFrame, *by: str) -> DataFrame:
    """Rows ordered by columns without regard to case, ties by the columns as they are."""
    return rows.orderBy(*(F.lower(c) for c in by), *by)


def exact_or_error(results: DataFrame, *differences: str) -> DataFrame:
    """The results; one that differs from its source in any of the columns ends the job."""
    wrong = F.lit(False)
    for c in differences:
        wrong |= F.col(c) != 0
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("a result differs from its source: "), F.col("path")))).otherwise(F.col("path"))
    return results.withColumn("path", checked)


#: Measures of a codec's run, by their names in a measurement row.
MEASURES = ("bytes", "seconds", "cpu", "peak_working_set", "peak_private", "peak_commit", "difference")


def measurement_rows(runs: DataFrame, codecs: tuple[str, ...]) -> DataFrame:
    """A row of 28 columns, for three codecs, for each image. runs: path, category, width, height, pixels, model, digest, codec and MEASURES."""
    image = ["path", "category", "width", "height", "pixels", "model", "digest"]
    return runs.groupBy(*image).agg(*(F.max(F.when(F.col("codec") == c, F.col(m))).alias(f"{c}_{m}") for m in MEASURES for c in codecs))


def quick_averages(runs: DataFrame) -> DataFrame:
    """Mean encode and decode time of each codec and image, in whole microseconds, halves up. runs: path, codec, run, encode, decode; the first
    run (0) warms up and does not count."""
    n, mean = F.count("*"), lambda c: F.floor((2 * F.sum(c) + F.count("*")) / (2 * F.count("*"))).cast("long").alias(c)
    return runs.filter("run > 0").groupBy("path", "codec").agg(n.alias("runs"), mean("encode"), mean("decode"))


def first_per_group(rows: DataFrame, group: str, order: str, n: int = 10) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(order))).filter(F.col("place") <= n)


def safe_stem(name: Column) -> Column:
    """A file name's stem fit for any file system."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(stem, "[^A-Za-z0-9._]+", "_"), F.lit("_")), F.lit("")), F.lit("image"))


def percent(value: Column, reference: Column) -> Column:
    """How much value is above reference, in percent to three places, half to even; 0 if reference is."""
    return F.when(reference == 0, 0.0).otherwise(F.bround(100.0 * (value - reference) / reference, 3))


def ratio(value: Column, reference: Column) -> Column:
    return F.when(reference == 0, 0.0).otherwise(F.bround(value / reference, 3))


def codec_summary(results: DataFrame, codecs: tuple[str, ...]) -> DataFrame:
    """A row for each codec: bytes, microseconds, pixels per second, largest and median peak. results has c_bytes, c_us and c_peak for each codec c."""
    rows = results.select("pixels", F.explode(F.array(*(F.struct(F.lit(c).alias("codec"), F.col(f"{c}_bytes").alias("bytes"), F.col(f"{c}_us").alias("us"), F.col(f"{c}_peak").alias("peak")) for c in codecs))).alias("r"))
    rows = rows.select("pixels", "r.*")
    speed = F.when(F.sum("us") == 0, 0.0).otherwise(F.bround(F.sum("pixels") / F.sum("us"), 3))
    totals = rows.groupBy("codec").agg(F.sum("bytes").alias("bytes"), F.sum("us").alias("us"), speed.alias("mp_per_s"), F.max("peak").alias("peak_max"))
    return totals.join(median(rows, "codec", "peak").withColumnRenamed("median", "peak_median"), "codec")


def median(rows: DataFrame, by: str, value: str, fine: int = 1 << 12) -> DataFrame:
    """by and median, the mean of the two middle values, as a whole number with halves to even. value: whole numbers.

    Values are counted before the exchange, then summed by ranges of `fine` values and, in the range or two that hold the middle, one by one. No task
    holds all values of a group, only its ranges."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(value).cast("long").alias("_v")).agg(F.count("*").alias("_n"))
    ranges = counts.groupBy("_by", F.floor(F.col("_v") / fine).alias("_r")).agg(F.sum("_n").alias("_m"))
    upto = W.partitionBy("_by").orderBy("_r")
    ranges = ranges.withColumns({"_below": F.sum("_m").over(upto) - F.col("_m"), "_all": F.sum("_m").over(W.partitionBy("_by"))})
    low, high = F.expr("(_all + 1) div 2"), F.expr("_all div 2 + 1")
    middle = ranges.filter((F.col("_below") < high) & (F.col("_below") + F.col("_m") >= low)).select(F.col("_by").alias("_b"), "_r", "_below", "_all")
    some = counts.join(middle, (F.col("_by") == F.col("_b")) & (F.floor(F.col("_v") / fine) == F.col("_r")))
    some = some.withColumn("_upto", F.col("_below") + F.sum("_n").over(W.partitionBy("_by", "_r").orderBy("_v")))
    two = some.groupBy("_by").agg(F.min(F.when(F.col("_upto") >= low, F.col("_v"))).alias("a"), F.min(F.when(F.col("_upto") >= high, F.col("_v"))).alias("b"))
    return two.select(F.col("_by").alias(by), F.bround((F.col("a") + F.col("b")) / 2).cast("long").alias("median"))


def compare(results: DataFrame, *by: str) -> DataFrame:
    """Codec a against b and c, for each group: sizes and times in percent, wins and exact results. Groups don't tell upper from lower case."""
    keys = [F.lower(c).alias(c) for c in by]
    s = lambda c: F.sum(c)
    return results.groupBy(*keys).agg(
        F.count("*").alias("images"), F.bround(s("pixels") / 1e6, 3).alias("megapixels"), s("a_bytes").alias("a_bytes"), s("b_bytes").alias("b_bytes"), s("c_bytes").alias("c_bytes"),
        percent(s("a_bytes"), s("b_bytes")).alias("size_vs_b"), percent(s("a_bytes"), s("c_bytes")).alias("size_vs_c"), percent(s("b_us"), s("a_us")).alias("speed_vs_b"),
        ratio(s("c_us"), s("a_us")).alias("time_ratio"), F.count_if(F.col("a_bytes") < F.col("c_bytes")).alias("wins_c"), F.count_if(F.col("a_bytes") < F.col("b_bytes")).alias("wins_b"),
        F.count_if(F.col("a_bytes") == F.col("b_bytes")).alias("ties_b"), F.count_if(F.col("difference") == 0).alias("exact"),
    )


def equal_weight_mean(compared: DataFrame) -> DataFrame:
    """Means over groups, each of the same weight, of the percents already rounded; in thousandths so that no order of adding matters."""
    mean = lambda c: F.bround(F.sum(F.bround(F.col(c) * 1000).cast("long")) / F.count("*") / 1000, 3)
    return compared.agg(mean("size_vs_b").alias("size_vs_b"), mean("size_vs_c").alias("size_vs_c"), F.count("*").alias("groups"))


def pixel_difference(one: DataFrame, two: DataFrame, *keys: str) -> DataFrame:
    """img and mismatches: places where two images differ, or that only one has."""
    b = two.select(*keys, F.col("v").alias("_v"))
    return one.join(b, list(keys), "full").groupBy("img").agg(F.count_if(~F.col("v").eqNullSafe(F.col("_v"))).alias("mismatches"))
