"""The corpus operators as queries over the driver tables: name -> f(spark, sf_dir)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ptrack.llm import (clusters, language_model, licences, mixing, packing, resampling, secrets, shards, shingle_join, simhash, token_files,
                        toxicity, vectors)
from ptrack.llm.common import table
from ptrack.llm.oracle import ORACLE  # noqa: F401
from ptrack.llm.tokens import vocabulary

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_token_files(spark, d):
    manifest = token_files.write_token_files(table(spark, d, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)
    return token_files.read_token_files(manifest)


@query
def op9_best_fit_packing(spark, d):
    return packing.packed(table(spark, d, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)


@query
def op7_secret_scan(spark, d):
    return secrets.secret_report(table(spark, d, "documents"))


@query
def op10_simhash(spark, d):
    return simhash.edited_fingerprints(table(spark, d, "documents"))


@query
def op1_vector_dedup(spark, d):
    return vectors.near_vectors(table(spark, d, "embeddings"))


@query
def op3_mix_sources(spark, d):
    mixed = mixing.mix(table(spark, d, "documents"))
    return mixed.select("doc_id", *[F.col(f"__{m}").alias(m) for m in mixing.MARGINS], F.col("__tokens").alias("n_tokens"),
                        F.round("__rate", 9).alias("rate"), F.col("__sampled").alias("sampled"))


@query
def op6_licence_scan(spark, d):
    # the tables know no files: a source is a project, a language a folder, 64 ids a folder in it
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 64).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = table(spark, d, "documents").select(F.col("doc_id").alias("file"), path.alias("path"), "text")
    return licences.licence_scan(files).withColumnRenamed("file", "doc_id")


@query
def op5_toxicity(spark, d):
    return toxicity.classify(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op8_shingle_join(spark, d):
    return shingle_join.similar_classes(table(spark, d, "documents"))


@query
def op4_language_model(spark, d):
    return language_model.score_documents(table(spark, d, "documents"))


@query
def op11_centroid_clusters(spark, d):
    return clusters.clusters(table(spark, d, "embeddings"))


@query
def op12_rendezvous_shards(spark, d):
    return shards.shard_report(table(spark, d, "documents"))


@query
def op13_importance_resampling(spark, d):
    return resampling.importance_ranks(table(spark, d, "documents"), table(spark, d, "benchmark"))
