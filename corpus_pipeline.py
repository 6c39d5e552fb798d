"""A corpus pipeline over ``documents``: quality, near duplicates, repeated passages, mixing and packing.

Each stage takes what the one before it wrote to Parquet; all but the last return documents with their columns. Every
stage covers all rows and whole texts of its input. Rows whose text a stage changes get its n_chars anew.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import _scratch, mixing, packing, quality, simhash, substring_dedup


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of operator 6 rejects go: by the mean of its weights or by strong single words. Its Gumbel
    draw would take a share of the clean documents too, so it has no part here. A null text is empty and stays; rows of a null
    or repeated doc_id are judged like any; an empty table gives no rows."""
    return quality.kept(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates by SimHash (5 words, similarity 0.8), the smallest doc_id stays. Rows of a null doc_id
    stay; texts without words are one group; texts of one doc_id are each judged by themselves."""
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 or more words that a document of smaller doc_id has go; a document of which nothing is left goes.
    Null and empty texts and rows of a null doc_id stay; rows of one doc_id are each judged by their own text."""
    return substring_dedup.without_repeats(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair schedule of their sources' target weights. A null source is the source '';
    null and repeated doc_ids are rows like any."""
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in packed sequences; a task packs the mix's neighbours. A null or empty text is the end id
    alone; null and repeated doc_ids are packed like any."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing_sources", mixed_sources),
    ("packing", packed_sequences),
]

#: Trained models, probabilistic buckets, hashes and a tokenizer: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of sf_dir, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = _scratch.new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
