"""A corpus pipeline of five stages; each is one operator of lectern.llm over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import mixing, ngram_join, packing, pii, quality
from lectern.session import shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The mix keeps this share of the tokens that reach it, each document once.
MIX_FRACTION, MIX_EPOCHS = 0.8, 1


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.classify(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest doc_id stays; a row that repeats wholly stays once.

    Documents without words link with nothing and stay.
    """
    return ngram_join.keep_one(docs).select(*COLUMNS)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away are replaced; n_chars follows the text."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, MIX_FRACTION, MIX_EPOCHS).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece, as op3 returns them."""
    return packing.pack(docs, keep_ids=False).drop("ids")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/lectern/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Classifying, packing and exact shingle joins are not SQL's; tests/llm holds them against brute force.
ORACLE_SQL = None
