"""The queries of this subpackage: each applies its operator to its whole table and derives the columns
that its contract asks for. ORACLES holds their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import metric_tree, mixing, near_duplicates, packing, quality_classifier, quality_rules, repeats, token_files, url_filters, warc
from tessera.llm.common import read, written
from tessera.llm.tokens import tokenizer_path

#: A passage of over 50 words, in words; they are counted beside the removed strings, for most have less than 400 bytes.
PASSAGE = 51


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = repeats.remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"), words=PASSAGE, cut=False)
    return docs.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_ids(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), end_id=0)
    docs = token_files.read_ids(manifest)
    return docs.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = written(read(spark, sf_dir, "documents", "doc_id", "source", mixing.n_words("text").alias("size")), "sizes")
    return mixing.mix(sizes, size="size").select("doc_id", "size", "source_size", "target", "taken")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    net = quality_classifier.fit(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))
    found = quality_classifier.scored(docs, net)
    good = F.when(F.col("score") >= quality_classifier.GOOD, 1).otherwise(0)
    return found.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", good.cast("int").alias("predicted"))


def op5_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.top_k(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents", "doc_id", "lang", "source", "text"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(read(spark, sf_dir, "pages", "page_id", "url", "html")))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read(spark, sf_dir, "pages", "page_id", "url")).drop("score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), words=2)


QUERIES = {
    "op1_repeats": op1_repeats,
    "op2_token_files": op2_token_files,
    "op3_mixing": op3_mixing,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_metric_tree": op5_metric_tree,
    "op6_quality_rules": op6_quality_rules,
    "op7_warc": op7_warc,
    "op8_url_filters": op8_url_filters,
    "op9_packing": op9_packing,
    "op10_near_duplicates": op10_near_duplicates,
}
ORACLES = {"op1_repeats": repeats.sql(), "op3_mixing": mixing.SQL, "op5_metric_tree": metric_tree.SQL, "op6_quality_rules": quality_rules.sql(), "op7_warc": warc.SQL, "op10_near_duplicates": near_duplicates.sql(2)}
