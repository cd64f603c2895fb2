"""Registered queries of the numbered operators, over the driver's tables."""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from visagelake.llm import bpe, chat, codes, decontamination, html, merkle, neardup, quality, rules, secrets, sharding, token_files, urls
from visagelake.operators import tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digests(bpe.encode_and_decode(table(spark, sf_dir, "documents"), path))


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(chat.link(table(spark, sf_dir, "conversations")))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = f"{tables.folder(spark)}/visagelake/tokens-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), target)
    return token_files.digests(spark, target)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_neardup": op1_neardup, "op2_decontamination": op2_decontamination, "op3_urls": op3_urls, "op4_quality": op4_quality, "op5_chat": op5_chat, "op6_html": op6_html, "op7_sharding": op7_sharding, "op8_secrets": op8_secrets, "op9_rules": op9_rules, "op10_bpe": op10_bpe, "op11_token_files": op11_token_files, "op12_merkle": op12_merkle, "op13_codes": op13_codes}
ORACLE: dict[str, str] = {"op1_neardup": neardup.ORACLE, "op3_urls": urls.oracle(), "op12_merkle": merkle.ORACLE, "op13_codes": codes.oracle()}
