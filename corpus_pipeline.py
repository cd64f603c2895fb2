"""The training-data pipeline: five stages from raw documents to token ids.

Each stage works on all rows that the one before it kept; run() writes every stage's rows as Parquet into the shared
folder of the cluster and rereads them. All stages take empty tables, texts of any length, repeated rows and nulls in any
column, and carry the columns of documents only, so that others cannot clash; the last adds its own.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from visagelake.llm import bpe, decontamination, neardup, quality, secrets
from visagelake.operators import tables

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour classifier scores 0.5 or more. Null and empty texts score 0 and go; equal texts
    score alike, so that repeated rows all stay or all go; a null id changes nothing."""
    return quality.keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies: five-word shingles, similarity 0.8 or more.
    Texts without words and rows without an id are copies of nothing and stay; rows of one id all stay or all go."""
    return neardup.keep_first(docs.select(*COLUMNS), words=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, neither word for word nor with other names and numbers. Null and empty texts
    hold none; rows without an id cannot be named in the join and stay; repeated rows all stay or all go."""
    return decontamination.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in the text replaced by a mark and n_chars set anew. A null text stays null, an
    empty one empty; repeated rows are cut alike."""
    return secrets.redact(docs.select(*COLUMNS))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of the ids and of the text decoded from them. A null text counts as an
    empty one, without tokens; repeated rows are encoded alike."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digests(bpe.encode_and_decode(docs, path), more=("token_ids",))


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", neardup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("byte-level BPE", bpe_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = tables.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
