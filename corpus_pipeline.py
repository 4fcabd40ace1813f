"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept,
and returns a DataFrame that is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seamline.llm import langid, minhash, packing, queries, toxicity
from seamline.llm.common import Scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language, or whose language is less likely than all others together, go."""
    return langid.keep_identified(docs, queries.language_model(docs))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score as toxic go; the classifier learns from the labels of the documents that are left."""
    return toxicity.keep_clean(docs, queries.toxicity_model(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return minhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and forms come nearer to even shares."""
    return queries.mixed(docs).where("mix_keep").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 1024 tokens."""
    # few words are kept, as the workers still hold what earlier stages left
    pieces = packing.pieces(docs, queries.tokenizer_path("byte_bpe_50k.json"), words=250_000)
    return packing.pack(pieces).withColumnRenamed("id", "doc_id")


STAGES = [("language", language), ("toxicity", clean), ("near_dedup", near_dedup), ("mixture", mixture), ("packing", packed)]

#: Trained models, hashing and packing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own table goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        own = Scratch(spark)
        docs = own.cut(stage(spark, docs, sf_dir), name)
        if before:
            before.clear()
        before = own
    return docs
