"""A corpus pipeline: toxic documents go, one of each group of near-duplicates stays, personal data is replaced,
quality is brought to target weights, and what is left is tokenized.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.llm import bpe, minhash, mixing, pii, toxicity
from quakespark.llm.common import shared_dir, table

#: Target shares of tokens by quality. Rates aren't below 1, so that mixing repeats documents and drops none.
TARGETS = {"0": 0.1, "1": 0.9}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near-duplicates; documents without doc_id stay.

    A doc_id may have several texts: a row stays if its own text's class has that doc_id. Rows that repeat both stay together.
    """
    classes = minhash.near_duplicates(docs)
    stay = classes.where("kept and doc_id is not null").select(F.col("doc_id").alias("_near_id"), F.col("digest").alias("_near_digest")).distinct()
    own = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    met = docs.join(stay, (F.col("doc_id") == F.col("_near_id")) & (own == F.col("_near_digest")), "left_semi")
    return met.select(docs.columns).unionByName(docs.where("doc_id is null"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the names of their kinds."""
    return pii.clean(docs)


def mix_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says, so that expected tokens by quality meet the targets."""
    rates = mixing.mix(docs, table(spark, sf_dir, "labels"), F.col("quality").cast("string"), TARGETS, least=1.0, grow=True)
    copies = rates.groupBy("doc_id").agg(F.max("copies").alias("copies"))
    known = docs.join(copies, "doc_id", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.coalesce("copies", F.lit(1)), F.lit(1)).cast("long"))))
    return known.select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digests."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("pii", replace_personal_data),
    ("mixing", mix_quality),
    ("byte_bpe", tokenize),
]

#: No stage can be said in SQL: a fitted classifier, sketches with alignment, checksums, fitted rates, byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
