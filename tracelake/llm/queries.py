"""The queries of this subpackage: thin calls of the operators on whole tables."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import bpe, cotraining, decontaminate, licenses, lloyd, neardup, quality, search, secrets, sharding, simhash, toxicity, urls
from tracelake.llm.common import shared_dir, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.report(table(spark, sf_dir, "pages"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), words=2)


def op5_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the map of each input folder is stored under its path's hash, in the folder that driver and executors share
    return sharding.report(table(spark, sf_dir, "documents"), at=f"{shared_dir(spark)}/shard-map-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.report(table(spark, sf_dir, "embeddings"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def queries() -> dict:
    made = [op1_secrets, op2_quality, op3_urls, op4_neardup, op5_cotraining, op6_licenses, op7_toxicity, op8_sharding, op9_decontaminate, op10_bpe, op11_search, op12_lloyd, op13_simhash]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op3_urls": urls.SQL, "op4_neardup": neardup.SQL, "op9_decontaminate": decontaminate.SQL, "op11_search": search.SQL, "op12_lloyd": lloyd.SQL}
