"""A corpus pipeline over `documents`: the stages in order, each written as Parquet and read again by the next.

toxicity: documents that the classifier rejects go. near_duplicates: of each group one document stays. decontamination:
documents that share ten words in a row with a benchmark item go. secrets: what the scan finds is replaced in the text.
packing: the texts are tokenized and packed; its rows are the pieces.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursegrid.llm import near_dup, packing, secret_ledger, toxicity, winnowing
from coursegrid.llm.shared import shared_folder

TOKENIZER = "byte_bpe_50k.json"


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, a similarity of 0.8 or more."""
    return near_dup.clean(docs, shingle=5, threshold=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnowing.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts with marks in place of secrets, and their new length."""
    clean = secret_ledger.redact(docs)
    kind = clean.schema["n_chars"].dataType
    changed = F.when(F.col("text").contains(secret_ledger.MARK), F.length("text").cast(kind))
    return clean.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER)).drop("ids")


STAGES = [
    ("toxicity", not_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: The classifier, the tokenizer and the connected components are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage keeps is written to the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
