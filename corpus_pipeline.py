"""A corpus pipeline of five stages over ``documents``; each is written as Parquet and read again by the next.

Toxic documents go, then those of low quality, then all but one of each group of near duplicates; personal data gets
pseudonyms, and what is left is packed into token windows. The four first stages return the columns of their input, other
columns than those they read included. Null and empty texts are defined for each: they pass toxicity, fail quality, have no
near duplicates, hold no personal data and are packed as their end token alone. An empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.minhash import without_duplicates
from gridloom.llm.packing import pack_documents
from gridloom.llm.pii import pseudonymise
from gridloom.llm.quality import without_low_quality
from gridloom.llm.queries import TOKENIZER
from gridloom.llm.shared import new_folder, table
from gridloom.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a classifier learned from ``labels`` predicts to be toxic; ids beside a label or without
    one are scored alike, and without labels nothing goes."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of fewer than 50 words, of repeated words, or unlike their language."""
    return without_low_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more of their shingles of five words, the one of least
    id; a null id is in no group."""
    return without_duplicates(docs, width=5, percent=80)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms; n_chars is that of the new text. The key is the session's (see
    ``pseudonymise``), or one drawn for this run."""
    return pseudonymise(docs).select(*(F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows of 2048; every token of every document lies in one."""
    return pack_documents(docs, TOKENIZER, window=2048, end_id=1).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: Trees, graph components and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
