"""A training-corpus pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns a DataFrame; ``run`` writes each as Parquet in the cluster's
shared folder and rereads it for the next.  All but the last stage return the
columns of ``documents``.

1. language ID: documents without a known language (no letter) go
2. n-gram Jaccard join: five words, similarity 0.8 or more; one document of
   each group stays, the smallest doc_id
3. secret scans: secrets are replaced in the text, n_chars follows
4. mixing: documents repeat or drop out until sources meet their targets
5. packing: pieces of at most 4096 tokens in sequences
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from skupulse.llm import common, jaccard, langid, mixing, packing, secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, n=5, num=8, den=10)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("secret scans", secret_scan),
          ("mixing", source_mix), ("packing", pack)]

# Fitted models, hashed shingles and a tokenizer: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
