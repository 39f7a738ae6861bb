"""From documents to packed training sequences, in five stages.

Toxic documents go, one document of each class of near copies stays, secrets are masked,
sources are mixed to target weights, and what is left is packed. Each stage takes all that
its predecessor kept; all but the last return the columns of documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ptrack.llm import mixing, packing, secrets, shingle_join, toxicity
from ptrack.llm.common import stored, table
from ptrack.llm.tokens import REMEMBERED, vocabulary
from ptrack.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return shingle_join.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sampled(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    # executors have grown with four other stages by now: workers remember an eighth of the chunks
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024, remembered=REMEMBERED // 8)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("secrets", mask_secrets), ("mixing", mix_sources), ("packing", pack_sequences)]
# The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
