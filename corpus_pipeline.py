"""From raw documents to packed training sequences, in five stages.

Every stage works on all that the one before kept, and its result is a table in the shared folder before the next begins,
so a lost executor repeats a part of one stage at most. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, near_duplicates, packing, quality_classifier, repeats
from tessera.llm.common import written
from tessera.llm.tokens import tokenizer_path

#: A passage of over 50 words, in words.
PASSAGE = 51
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labels, does not reject.

    Null and empty texts are scored like any other. Rows with equal doc_id are judged each by its own text. Columns other than those of
    documents go. Without labelled rows the network says the same of all; an empty table gives no rows."""
    net = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.scored(docs, net).filter(F.col("score") >= quality_classifier.GOOD).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity of 0.8 or more): that with the smallest doc_id.

    Texts that are null, empty or blank are no duplicates of anything and stay. Rows with equal doc_id are one document: they all stay or
    all go. Rows with a null doc_id stay."""
    found = near_duplicates.near_duplicates(docs)
    return docs.join(found.filter("NOT kept").select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 400 bytes, and passages of over 50 words, that start anywhere else too. A character of which only some bytes
    remain is dropped.

    Every row stays, if only with an empty text; a null text stays null. Rows that repeat each other, with equal doc_id or not, lose what
    they share."""
    found = repeats.remove_repeats(docs, words=PASSAGE)
    left = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("�"), F.lit(""))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(left)
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each time a document is taken, and a text's leading words where that is all that
    a target has room for.

    A null source is a source, the last. Documents without words have no size and are not taken. Rows with equal doc_id are taken each."""
    found = mixing.repeated(mixing.mix(docs))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all rows, packed into sequences of at most 4096. A null or empty text has the end id alone; rows with equal or null
    doc_id are packed each."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality_classifier", good_documents),
    ("near_duplicates", one_of_each),
    ("repeats", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]
#: A network, components and byte strings have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
