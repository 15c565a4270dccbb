"""Queries of corpus preparation and codec comparison, with their SQL.

`documents` stands in for files (source for the archive, text for the content), `lineitem` for measured results of three codecs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import corpus, frames
from tessera.sources import foreign, reports


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def corpus_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.first_of_each(_documents(spark, sf_dir).select("source", "doc_id", "text"), "text", "source", "doc_id")
    return found.select("source", "doc_id", "digest", "copies", "first")


CORPUS_DEDUP = """
SELECT source, doc_id, digest, count(*) OVER (PARTITION BY digest) AS copies, row_number() OVER (PARTITION BY digest ORDER BY source, doc_id) = 1 AS first
FROM (SELECT source, doc_id, sha256(text) AS digest FROM documents)"""

_SIZES = "SELECT doc_id, lang, source, CAST(n_chars * 7 % 20000 AS INT) AS width, CAST(n_chars * 13 % 9000 AS INT) AS height FROM documents"


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).selectExpr("doc_id", "lang", "source", "CAST(n_chars * 7 % 20000 AS INT) AS width", "CAST(n_chars * 13 % 9000 AS INT) AS height")


def corpus_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = corpus.exclusion(F.col("width"), F.col("height"))
    return _sized(spark, sf_dir).withColumn("reason", reason).filter("reason IS NOT NULL").select("doc_id", "width", "height", "reason")


CORPUS_EXCLUDED = f"""
SELECT * FROM (SELECT doc_id, width, height, CASE WHEN width > 16383 OR height > 16383 THEN 'dimension limit' WHEN CAST(width AS BIGINT) * height > 16000000 THEN 'pixel ceiling' END AS reason
FROM ({_SIZES})) WHERE reason IS NOT NULL"""


def corpus_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten documents of each source."""
    return corpus.first_per_group(_documents(spark, sf_dir).select("source", "doc_id", "n_chars"), "source", "doc_id")


CORPUS_TOPN = "SELECT source, doc_id, n_chars, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS place FROM documents QUALIFY place <= 10"


def corpus_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and pixels by category and in all, of what is not excluded."""
    kept = _sized(spark, sf_dir).filter(corpus.exclusion(F.col("width"), F.col("height")).isNull())
    pixels = F.sum(F.col("width").cast("long") * F.col("height")).alias("pixels")
    by = kept.groupBy("lang").agg(F.count("*").alias("images"), pixels)
    return by.unionByName(kept.agg(F.lit("(all)").alias("lang"), F.count("*").alias("images"), pixels))


CORPUS_ROLLUP = f"""
WITH k AS (SELECT * FROM ({_SIZES}) WHERE width <= 16383 AND height <= 16383 AND CAST(width AS BIGINT) * height <= 16000000)
SELECT lang, count(*) AS images, CAST(sum(CAST(width AS BIGINT) * height) AS BIGINT) AS pixels FROM k GROUP BY lang
UNION ALL SELECT '(all)', count(*), CAST(sum(CAST(width AS BIGINT) * height) AS BIGINT) FROM k"""


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names from whole texts."""
    return _documents(spark, sf_dir).select("doc_id", corpus.safe_stem(F.concat("text", F.lit(".png"))).alias("stem"))


SAFE_NAMES = r"""
SELECT doc_id, coalesce(nullif(trim(regexp_replace(regexp_replace(text || '.png', '\.[^.]*$', ''), '[^A-Za-z0-9._]+', '_', 'g'), '_'), ''), 'image') AS stem FROM documents"""

_RESULTS = """
    l_returnflag || l_linestatus AS category, CASE WHEN l_linenumber % 2 = 0 THEN 'RGB' ELSE 'RGBA' END AS model, CAST(l_quantity AS BIGINT) * 1000 AS pixels,
    CAST(l_orderkey % 4096 AS BIGINT) + 1000 AS a_bytes, CAST(l_partkey % 4096 AS BIGINT) + 1000 AS b_bytes, CAST(l_suppkey * 37 % 4096 AS BIGINT) + 1000 AS c_bytes,
    CAST(l_orderkey % 977 AS BIGINT) AS a_us, CAST(l_partkey % 1009 AS BIGINT) AS b_us, CAST(l_suppkey * 11 % 9973 AS BIGINT) AS c_us,
    CAST(l_orderkey * 31 % 100003 AS BIGINT) AS a_peak, CAST(l_partkey * 17 % 100003 AS BIGINT) AS b_peak, CAST(l_suppkey * 13 % 100003 AS BIGINT) AS c_peak,
    CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END AS difference"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    table.createOrReplaceTempView("_measured")
    return spark.sql(f"SELECT {_RESULTS} FROM _measured")


_FROM = f"(SELECT {_RESULTS} FROM lineitem)"


def codec_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.codec_summary(results(spark, sf_dir), ("a", "b", "c"))


CODEC_SUMMARY = f"WITH m AS {_FROM}, r AS (" + " UNION ALL ".join(f"SELECT pixels, '{c}' AS codec, {c}_bytes AS bytes, {c}_us AS us, {c}_peak AS peak FROM m" for c in "abc") + """)
SELECT codec, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(us) AS BIGINT) AS us, CASE WHEN sum(us) = 0 THEN 0.0 ELSE round_even(CAST(sum(pixels) AS DOUBLE) / CAST(sum(us) AS DOUBLE), 3) END AS mp_per_s,
    max(peak) AS peak_max, CAST(round_even(median(peak), 0) AS BIGINT) AS peak_median FROM r GROUP BY codec"""


def _percent(v: str, r: str) -> str:
    return f"CASE WHEN sum({r}) = 0 THEN 0.0 ELSE round_even(100.0::DOUBLE * CAST(sum({v}) - sum({r}) AS DOUBLE) / CAST(sum({r}) AS DOUBLE), 3) END"


def _compare_sql(by: str) -> str:
    return f"""SELECT lower({by}) AS {by}, count(*) AS images, round_even(CAST(sum(pixels) AS DOUBLE) / 1e6::DOUBLE, 3) AS megapixels, CAST(sum(a_bytes) AS BIGINT) AS a_bytes, CAST(sum(b_bytes) AS BIGINT) AS b_bytes, CAST(sum(c_bytes) AS BIGINT) AS c_bytes,
    {_percent('a_bytes', 'b_bytes')} AS size_vs_b, {_percent('a_bytes', 'c_bytes')} AS size_vs_c, {_percent('b_us', 'a_us')} AS speed_vs_b, CASE WHEN sum(a_us) = 0 THEN 0.0 ELSE round_even(CAST(sum(c_us) AS DOUBLE) / CAST(sum(a_us) AS DOUBLE), 3) END AS time_ratio,
    count(*) FILTER (WHERE a_bytes < c_bytes) AS wins_c, count(*) FILTER (WHERE a_bytes < b_bytes) AS wins_b, count(*) FILTER (WHERE a_bytes = b_bytes) AS ties_b, count(*) FILTER (WHERE difference = 0) AS exact FROM {_FROM} GROUP BY 1"""


def category_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.compare(results(spark, sf_dir), "category")


def color_model_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.compare(results(spark, sf_dir), "model")


def win_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.compare(results(spark, sf_dir)).select("images", "wins_b", "wins_c", "ties_b", "exact")


WIN_COUNTS = f"SELECT count(*) AS images, count(*) FILTER (WHERE a_bytes < b_bytes) AS wins_b, count(*) FILTER (WHERE a_bytes < c_bytes) AS wins_c, count(*) FILTER (WHERE a_bytes = b_bytes) AS ties_b, count(*) FILTER (WHERE difference = 0) AS exact FROM {_FROM}"


def equal_weight_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.equal_weight_mean(category_compare(spark, sf_dir))


EQUAL_WEIGHT_MEAN = "SELECT " + ", ".join(
    f"round_even(CAST(sum(CAST(round_even({c} * 1000, 0) AS BIGINT)) AS DOUBLE) / count(*) / 1000, 3) AS {c}" for c in ("size_vs_b", "size_vs_c")
) + f", count(*) AS groups FROM ({_compare_sql('category')})"


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Include-list and its complement: documents with and without a label, by language."""
    docs, labels = _documents(spark, sf_dir).select("doc_id", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
    listed, others = docs.join(labels, "doc_id", "left_semi"), docs.join(labels, "doc_id", "left_anti")
    both = listed.withColumn("listed", F.lit(True)).unionByName(others.withColumn("listed", F.lit(False)))
    return both.groupBy("lang", "listed").agg(F.count("*").alias("n"))


LABELLED_DOCUMENTS = "SELECT lang, doc_id IN (SELECT doc_id FROM labels) AS listed, count(*) AS n FROM documents GROUP BY ALL"

_FILES = """SELECT source || '/' || CAST(doc_id AS STRING) || '.png' AS path, lang AS category, source, doc_id, CAST(n_chars * 7 % 20000 AS INT) AS width, CAST(n_chars * 13 % 9000 AS INT) AS height,
    doc_id % 3 = 0 AS opaque, text FROM documents"""


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _documents(spark, sf_dir).createOrReplaceTempView("_files_of")
    files = spark.sql(_FILES.replace("FROM documents", "FROM _files_of"))
    kept = files.filter(corpus.exclusion(F.col("width"), F.col("height")).isNull())
    return corpus.manifest(corpus.first_of_each(kept, "text", "source", "doc_id").filter("first"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of the first of each content that isn't excluded."""
    return _listed(spark, sf_dir)


MANIFEST = f"""
SELECT path AS Path, category AS Category, width AS Width, height AS Height, CAST(width AS BIGINT) * height AS Pixels, CASE WHEN opaque THEN 'RGB' ELSE 'RGBA' END AS ColorModel, digest AS NormalizedSHA256, source AS Source
FROM (SELECT *, sha256(text) AS digest FROM ({_FILES}) WHERE width <= 16383 AND height <= 16383 AND CAST(width AS BIGINT) * height <= 16000000)
QUALIFY row_number() OVER (PARTITION BY digest ORDER BY source, doc_id) = 1"""


def manifest_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the manifest without a file; files are those of documents that carry a label."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
    files = _documents(spark, sf_dir).join(labels, "doc_id", "left_semi").selectExpr("concat(source, '/', CAST(doc_id AS STRING), '.png') AS path")
    return corpus.missing(_listed(spark, sf_dir), files).select("Path", "Source")


MANIFEST_MISSING = f"SELECT Path, Source FROM ({MANIFEST}) WHERE Path NOT IN (SELECT path FROM ({_FILES}) WHERE doc_id IN (SELECT doc_id FROM labels))"

_RUNS = """SELECT CAST(l_orderkey AS STRING) AS path, CASE l_returnflag WHEN 'A' THEN 'a' WHEN 'N' THEN 'b' ELSE 'c' END AS codec, l_linenumber - 1 AS run, CAST(l_partkey % 1009 AS BIGINT) AS encode, CAST(l_suppkey % 97 AS BIGINT) AS decode,
    CAST(l_orderkey % 7 AS STRING) AS category, CAST(l_orderkey % 4096 AS INT) AS width, CAST(l_orderkey % 977 AS INT) AS height, CAST(l_orderkey % 4096 * (l_orderkey % 977) AS BIGINT) AS pixels, 'RGB' AS model, CAST(l_orderkey * 31 AS STRING) AS digest,
    CAST(l_partkey AS BIGINT) AS bytes, CAST(l_partkey % 1009 AS BIGINT) AS seconds, CAST(l_partkey % 997 AS BIGINT) AS cpu, CAST(l_partkey * 3 AS BIGINT) AS peak_working_set, CAST(l_partkey * 5 AS BIGINT) AS peak_private,
    CAST(l_partkey * 7 AS BIGINT) AS peak_commit, CAST(0 AS BIGINT) AS difference FROM lineitem"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("_runs_of")
    return spark.sql(_RUNS.replace("FROM lineitem", "FROM _runs_of"))


def quick_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean times by image and codec after the first run."""
    return corpus.quick_averages(_runs(spark, sf_dir))


QUICK_BENCHMARK = f"SELECT path, codec, count(*) AS runs, CAST((2 * sum(encode) + count(*)) // (2 * count(*)) AS BIGINT) AS encode, CAST((2 * sum(decode) + count(*)) // (2 * count(*)) AS BIGINT) AS decode FROM ({_RUNS}) WHERE run > 0 GROUP BY path, codec"


def measurement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of 28 columns for each image."""
    return corpus.measurement_rows(_runs(spark, sf_dir), ("a", "b", "c"))


MEASUREMENT_ROWS = (
    "SELECT path, category, width, height, pixels, model, digest, "
    + ", ".join(f"max(CASE WHEN codec = '{c}' THEN {m} END) AS {c}_{m}" for m in corpus.MEASURES for c in "abc")
    + f" FROM ({_RUNS}) GROUP BY path, category, width, height, pixels, model, digest"
)


def first_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred rows of the manifest by path: the limit is the operator's own."""
    return corpus.first_images(_listed(spark, sf_dir).withColumnRenamed("Path", "path"), 100).select("path", "Source")


FIRST_IMAGES = f"SELECT Path AS path, Source FROM ({MANIFEST}) ORDER BY Path LIMIT 100"


def frame_play(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When frames begin while each sequence is played three times."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id AS anim", "event_id AS frame", "event_id * 7 % 50 AS delay")
    return frames.played(frames.timeline(events), 3)


FRAME_PLAY = """
WITH t AS (SELECT user_id AS anim, event_id AS frame, CASE WHEN event_id * 7 % 50 = 0 THEN 100 ELSE event_id * 7 % 50 END AS delay FROM events)
SELECT anim, l AS loop, frame, CAST(coalesce(sum(delay) OVER (PARTITION BY anim, l ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + l * sum(delay) OVER (PARTITION BY anim, l) AS BIGINT) AS start
FROM t, (SELECT unnest(range(3)) AS l)"""

def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup as a table in Markdown."""
    return reports.markdown(corpus_rollup(spark, sf_dir), "lang")


REPORT_LINES = f"""
WITH r AS ({CORPUS_ROLLUP})
SELECT 0 AS line, '| lang | images | pixels |' AS text UNION ALL SELECT 1, '|---|---:|---:|'
UNION ALL SELECT CAST(row_number() OVER (ORDER BY lower(lang), lang) + 1 AS INT), '| ' || lang || ' | ' || images || ' | ' || pixels || ' |' FROM r"""

_MADE = "SELECT vec_id, CAST(vec_id % 4 AS INT) AS kind, CAST(1 + vec_id * 7 % 16000 AS INT) AS w, CAST(1 + vec_id * 11 % 9000 AS INT) AS h, CAST(1 + vec_id % 3 AS INT) AS n, CAST(vec_id % 5 AS INT) AS delay, CASE WHEN vec_id % 7 = 0 THEN 16 ELSE 8 END AS bits FROM embeddings"


def foreign_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made files of three formats, as many as there are embeddings: what their headers tell."""
    spark.read.parquet(f"{sf_dir}/embeddings.parquet").createOrReplaceTempView("_made_of")
    made = spark.sql(_MADE.replace("FROM embeddings", "FROM _made_of"))

    def low(text: str, size: int) -> str:
        return f"array_join(transform(sequence(0, {size - 1}), i -> lpad(hex(shiftright(CAST({text} AS BIGINT), 8 * i) & 255), 2, '0')), '')"

    lossless = f"concat('52494646', {low('18', 4)}, '574542505650384C', {low('5', 4)}, '2F', {low('(w - 1) + (h - 1) * 16384L', 4)}, '00')"
    lossy = f"concat('52494646', {low('14', 4)}, '5745425056503820', {low('2', 4)}, '0000')"
    entry = lambda tag, v: f"{low(str(tag), 2)}, '030001000000', {low(v, 2)}, '0000'"
    tiff = f"concat('49492A0008000000', '0300', {entry(256, 'w')}, {entry(257, 'h')}, {entry(258, 'bits')}, '00000000')"
    frame = f"concat('21F90400', {low('delay', 2)}, '0000', '2C00000000', {low('w', 2)}, {low('h', 2)}, '0002014400')"
    gif = f"concat('474946383961', {low('w', 2)}, {low('h', 2)}, '000000', repeat({frame}, n), '3B')"
    files = made.select(F.col("vec_id").cast("string").alias("path"), F.expr(f"unhex(CASE kind WHEN 0 THEN {lossless} WHEN 1 THEN {lossy} WHEN 2 THEN {tiff} ELSE {gif} END)").alias("content"))
    found = foreign.checked(files).withColumn("delay", F.coalesce(F.expr("aggregate(delays, 0L, (a, d) -> a + d)"), F.lit(0)))
    zero = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c)
    return found.groupBy("format", "fit", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("files"), zero("width"), zero("height"), zero("frames"), zero("delay"))


FOREIGN_HEADERS = f"""
WITH m AS ({_MADE}),
k AS (SELECT *, CASE WHEN kind <= 1 THEN 'webp' WHEN kind = 2 THEN 'tiff' ELSE 'gif' END AS format, CASE WHEN kind = 1 THEN 'lossy' WHEN kind = 2 AND bits > 8 THEN 'over 8 bits' ELSE '' END AS reason FROM m)
SELECT format, reason = '' AS fit, reason, count(*) AS files, CAST(sum(CASE WHEN reason = '' THEN w ELSE 0 END) AS BIGINT) AS width, CAST(sum(CASE WHEN reason = '' THEN h ELSE 0 END) AS BIGINT) AS height,
    CAST(sum(CASE WHEN reason <> '' THEN 0 WHEN kind = 3 THEN n ELSE 1 END) AS BIGINT) AS frames, CAST(sum(CASE WHEN kind < 3 THEN 0 WHEN delay = 0 THEN 100 * n ELSE 10 * delay * n END) AS BIGINT) AS delay FROM k GROUP BY ALL"""

QUERIES = {
    "report_lines": report_lines, "foreign_headers": foreign_headers,
    "manifest": manifest, "manifest_missing": manifest_missing, "quick_benchmark": quick_benchmark, "measurement_rows": measurement_rows, "first_images": first_images, "frame_play": frame_play,
    "corpus_dedup": corpus_dedup, "corpus_excluded": corpus_excluded, "corpus_topn": corpus_topn, "corpus_rollup": corpus_rollup, "safe_names": safe_names,
    "codec_summary": codec_summary, "category_compare": category_compare, "color_model_compare": color_model_compare, "win_counts": win_counts,
    "equal_weight_mean": equal_weight_mean, "labelled_documents": labelled_documents,
}
ORACLES = {
    "report_lines": REPORT_LINES, "foreign_headers": FOREIGN_HEADERS,
    "manifest": MANIFEST, "manifest_missing": MANIFEST_MISSING, "quick_benchmark": QUICK_BENCHMARK, "measurement_rows": MEASUREMENT_ROWS, "first_images": FIRST_IMAGES, "frame_play": FRAME_PLAY,
    "corpus_dedup": CORPUS_DEDUP, "corpus_excluded": CORPUS_EXCLUDED, "corpus_topn": CORPUS_TOPN, "corpus_rollup": CORPUS_ROLLUP, "safe_names": SAFE_NAMES,
    "codec_summary": CODEC_SUMMARY, "category_compare": _compare_sql("category"), "color_model_compare": _compare_sql("model"), "win_counts": WIN_COUNTS,
    "equal_weight_mean": EQUAL_WEIGHT_MEAN, "labelled_documents": LABELLED_DOCUMENTS,
}
