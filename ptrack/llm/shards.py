"""Rendezvous hashing of stable record keys over weighted shards.

Every shard bids for a key: ln(u) / weight, with u in (0, 1) from a hash of the shard's number
and the key. The highest bid wins, and shard i gets weight_i / sum of the keys. A bid depends
on its own shard and the key alone, so one more shard takes keys into itself and moves no other,
and one shard less gives its keys away and moves no other. Bids are expressions in a projection:
no row is shuffled to learn its shard."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ptrack.llm.common import numbered, parts

SHARDS = 16
DIGITS = 13                          # hex digits of a bid's hash: 52 bits, exact as a double with the half


def bid(key: Column, shard: int, weight: float) -> Column:
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(shard)), key)), 1, DIGITS), 16, 10).cast("double")
    return F.log((h + 0.5) / F.lit(float(16 ** DIGITS))) / F.lit(float(weight))


def shard_of(key: Column, weights: list) -> Column:
    """The number of the shard that wins the key (a string); equal bids go to the smaller number.
    Shards without weight win nothing."""
    bids = [F.struct(bid(key, i, w).alias("bid"), F.lit(-i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    if not bids:
        raise ValueError("no shard has a weight")
    return -F.array_max(F.array(*bids))["shard"]


def even(shards: int) -> list:
    return [1.0] * shards


def with_shards(docs: DataFrame, weights: list | None = None, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """docs with the shard of every row. Rows of one key share a shard; rows without a key
    share that of the empty key."""
    return docs.withColumn(name, shard_of(F.coalesce(F.col(key).cast("string"), F.lit("")), weights or even(SHARDS)))


def shard_report(docs: DataFrame, weights: list | None = None, more: float = 1.0) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 1), text_crc32, law, shard, slot, grown_shard of
    every row of docs (doc_id, text; null text: no bytes). slot counts from 0 within a shard, in the
    order of doc_id (null first), text_crc32, size; rows alike in these share their places in any
    order. grown_shard is the shard with one more shard of weight `more` at the end. Repeated rows
    have one slot each. An empty table gives no rows; other columns are not read."""
    weights = weights or even(SHARDS)
    text = F.coalesce("text", F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"),
                       shard_of(key, weights).alias("shard"), shard_of(key, [*weights, more]).alias("grown_shard"))
    placed = numbered(rows, ["doc_id", "text_crc32", "size"], ["shard"], "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, folder: str, weights: list | None = None, key: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """Write docs as Parquet below folder/shard=0, 1, ... in files of bounded length. Rows are dealt
    by shard and a hash of the row, so a shard is written by many tasks whatever its weight."""
    salt = F.pmod(F.xxhash64(*docs.columns), F.lit(max(1, parts(docs.sparkSession) // 4)))
    (with_shards(docs, weights, key).repartition(parts(docs.sparkSession), "shard", salt)
     .write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(folder))
