"""The pixel_events view: an event stream derived from the lineitem table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ptrack.functions.ordered import dense_seq

SEQ_BITS = 32


def pixel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_idx, pid, x, y, t, p): one supplier is one moving particle."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").cast("bigint").alias("pid"), "l_orderkey", "l_linenumber",
        F.col("l_partkey").cast("bigint").alias("pk"),
        F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("price"),
        F.col("l_returnflag").alias("rf"))
    # A supplier may own a third of all rows: number its rows order range by order range.
    s = dense_seq(li, ["pid"], F.floor(F.col("l_orderkey") / 65536),
                  ["l_orderkey", "l_linenumber", "pk", "q", "price", "rf"])
    pid, pk, q = F.col("pid"), F.col("pk"), F.col("q").cast("bigint")
    s = s.withColumn("tl", F.col("seq") * 50 + pk % 50)
    x = 40 + (pid % 32) * 38 + F.floor(F.col("tl") * ((pid % 7) - 3) / 5000.0) + (q % 5) - 2
    y = (30 + (F.floor(pid / 32.0) % 17) * 40
         + F.floor(F.col("tl") * ((pid % 5) - 2) / 5000.0) + (pk % 5) - 2)
    return s.select(
        (F.shiftleft(pid, SEQ_BITS) + F.col("seq")).alias("event_idx"), "pid",
        x.cast("int").alias("x"), y.cast("int").alias("y"),
        (F.col("tl") + F.floor(pid / 544.0) * 40000).cast("double").alias("t"),
        F.when(F.col("rf") == "N", 0).otherwise(1).alias("p"))


# The same view for DuckDB, as a WITH item.
PIXEL_EVENTS_SQL = """
s0 AS (SELECT CAST(l_suppkey AS BIGINT) AS pid,
    ROW_NUMBER() OVER (PARTITION BY l_suppkey
      ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag) - 1 AS seq,
    CAST(l_partkey AS BIGINT) AS pk, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS rf FROM lineitem),
s1 AS (SELECT *, seq * 50 + pk % 50 AS tl FROM s0),
ev AS (SELECT pid * 4294967296 + seq AS event_idx, pid,
    CAST(40 + (pid % 32) * 38 + FLOOR(tl * ((pid % 7) - 3) / 5000.0) + (q % 5) - 2 AS INTEGER) AS x,
    CAST(30 + (CAST(FLOOR(pid / 32.0) AS BIGINT) % 17) * 40
         + FLOOR(tl * ((pid % 5) - 2) / 5000.0) + (pk % 5) - 2 AS INTEGER) AS y,
    CAST(tl + CAST(FLOOR(pid / 544.0) AS BIGINT) * 40000 AS DOUBLE) AS t,
    CAST(CASE WHEN rf = 'N' THEN 0 ELSE 1 END AS INTEGER) AS p FROM s1),
pos AS (SELECT * FROM ev WHERE p > 0)"""
