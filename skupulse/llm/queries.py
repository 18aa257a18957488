"""Registered queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skupulse.llm import (
    ann,
    extract,
    jaccard,
    langid,
    mixing,
    packing,
    periodic,
    quality,
    secrets,
    tokenfile,
    toxic,
    urls,
    whitening,
)
from skupulse.llm.common import read, shared_folder


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(read(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(read(spark, sf_dir, "pages"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), every=20, k=20)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), urls.rule_table(spark))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.predict(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"), n=3, num=90, den=100).select(
        "doc_id", "n_shingles", "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(read(spark, sf_dir, "embeddings"), most=4)
    # sums beyond a long (from some millions of vectors on) are null here, exact in the operator
    return found.withColumn("deviation", F.expr("try_cast(deviation as long)"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find_runs(periodic.repeat_some(read(spark, sf_dir, "documents"))))


def op13_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfile.write(read(spark, sf_dir, "documents"), folder)
    return tokenfile.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_html_extraction, op3_source_mix, op4_secret_scan, op5_nearest_neighbours, op6_url_filter,
    op7_packing, op8_toxicity, op9_jaccard_join, op10_quality_rules, op11_embedding_whitening, op12_periodic_runs,
    op13_token_output)}

ORACLES = {"op6_url_filter": urls.ORACLE, "op10_quality_rules": quality.ORACLE}
