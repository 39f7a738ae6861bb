"""Ordered computations cut into pieces of bounded size.

A plain window partitioned by a track or by a supplier puts a hot key into one
task. The helpers here cut every key into buckets or chunks, work inside them
and join the few per-bucket totals back.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def dense_seq(df: DataFrame, keys: list[str], bucket: Column, order: list, out: str = "seq",
              total: str | None = None) -> DataFrame:
    """0-based row number per ``keys`` in the order (bucket, *order), and with
    ``total`` the number of rows of the key.

    ``bucket`` must not decrease along the order. Rows are sorted per
    (keys, bucket) only; the running total runs over bucket counts."""
    b = df.withColumn("_b", bucket)
    kb = [*keys, "_b"]
    counts = b.groupBy(*kb).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*kb, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                            *([F.sum("_n").over(Window.partitionBy(*keys)).alias(total)] if total else []))
    inside = Window.partitionBy(*kb).orderBy(*order)
    return (b.withColumn("_r", F.row_number().over(inside) - 1)
            .join(offsets, kb)
            .withColumn(out, (F.col("_off") + F.col("_r")).cast("bigint"))
            .drop("_b", "_r", "_off"))


def dense_ids(ids: DataFrame, col: str, out: str, bucket: Column) -> DataFrame:
    """(col, out) with out = 0, 1, 2, … over the distinct values of ``col``."""
    return dense_seq(ids.select(col).distinct(), [], bucket, [col], out)


def with_halo(df: DataFrame, seq: str, chunk: int, before: int = 0, after: int = 0) -> DataFrame:
    """Give rows a chunk number ``_c`` and copy rows next to a chunk border into
    the neighbouring chunk (``_halo`` true). ``seq`` counts without gaps per key
    (from any start), so a window over (key, _c) sees the same neighbours as one
    over the key."""
    c = F.floor(F.col(seq) / chunk)
    pos = F.pmod(F.col(seq), F.lit(chunk))
    homes = F.array(F.struct(c.alias("_c"), F.lit(False).alias("_halo")))
    if before:
        nxt = F.array(F.struct((c + 1).alias("_c"), F.lit(True).alias("_halo")))
        homes = F.when(pos >= chunk - before, F.concat(homes, nxt)).otherwise(homes)
    if after:
        prv = F.array(F.struct((c - 1).alias("_c"), F.lit(True).alias("_halo")))
        homes = F.when(pos < after, F.concat(homes, prv)).otherwise(homes)
    return (df.withColumn("_h", F.explode(homes))
            .withColumn("_c", F.col("_h._c")).withColumn("_halo", F.col("_h._halo")).drop("_h"))


SMALL = 500_000      # values up to which one aggregate holds them all
_ACC = 10_000


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], rows: int | None = None) -> dict[str, float | None]:
    """Exact quantiles (linear interpolation, nulls and NaN skipped) of
    materialised columns: {name: (column, q)} -> {name: value}; ``rows``, if known, is the number
    of rows.

    Large columns are narrowed by an approximate quantile with a guaranteed
    rank error first; only the band around the wanted rank is sorted."""
    ok = {n: F.when(~F.isnan(c), F.col(c)) for n, (c, _) in wanted.items()}
    eps = 4.0 / _ACC
    aggs = []
    for n, (_, q) in wanted.items():
        aggs += [F.count(ok[n]).alias(f"n_{n}"),
                 F.percentile_approx(ok[n], [max(0.0, q - eps), min(1.0, q + eps)], _ACC).alias(f"b_{n}")]
    if rows is not None and rows <= SMALL:
        small = list(wanted)
    else:
        head = df.agg(*aggs).first()
        small = [n for n in wanted if head[f"n_{n}"] <= SMALL]
    out: dict[str, float | None] = {}
    if small:
        row = df.agg(*[F.percentile(ok[n], wanted[n][1]).alias(n) for n in small]).first()
        out.update({n: row[n] for n in small})
    for n in wanted:
        if n in out:
            continue
        pos = (head[f"n_{n}"] - 1) * wanted[n][1]
        i = int(pos)
        j = i if pos == i else i + 1
        lo, hi = head[f"b_{n}"]
        v = df.select(ok[n].alias("v"))
        below = v.where(F.col("v") < lo).count()
        band = v.where(F.col("v").between(lo, hi)).groupBy("v").count()
        cum = band.select("v", (F.sum("count").over(Window.orderBy("v")) + below).alias("cum"))
        r = cum.agg(F.min(F.when(F.col("cum") > i, F.col("v"))).alias("a"),
                    F.min(F.when(F.col("cum") > j, F.col("v"))).alias("b")).first()
        out[n] = r["a"] + (r["b"] - r["a"]) * (pos - i)
    return out


def quantiles_by(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact quantiles as above for each value of the keys (nulls are a value): (*keys, one
    column for each name, null without values). ``df`` must be materialised. Only the band
    around a rank is sorted: a few rows of ten thousand, or of five thousand values all."""
    eps = 4.0 / _ACC
    names = list(wanted)
    v = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(q).alias("q"), F.col(c).cast("double").alias("v"))
                            for n, (c, q) in wanted.items()])).alias("s")
    long = df.select(F.struct(*keys).alias("key"), v).select("key", "s.*").where(F.col("v").isNotNull() & ~F.isnan("v"))
    head = None
    for q in sorted({q for _, q in wanted.values()}):
        part = (long.where(F.col("q") == q).groupBy("key", "name")
                .agg(F.count(F.lit(1)).alias("n"), F.first("q").alias("q"), F.min("v").alias("least"), F.max("v").alias("most"),
                     F.percentile_approx("v", [max(0.0, q - eps), min(1.0, q + eps)], _ACC).alias("b")))
        head = part if head is None else head.unionByName(part)
    head = head.select(F.col("key").alias("_key"), F.col("name").alias("_name"), "n", (F.col("q") * (F.col("n") - 1)).alias("pos"),
                       F.when(F.col("n") * eps < 2, F.col("least")).otherwise(F.col("b")[0]).alias("low"),
                       F.when(F.col("n") * eps < 2, F.col("most")).otherwise(F.col("b")[1]).alias("high"))
    d = long.join(head, F.col("key").eqNullSafe(F.col("_key")) & (F.col("name") == F.col("_name")))
    low, high = F.col("low"), F.col("high")
    # what lies below the band is one row with a count, what lies above is not needed
    band = (d.where(F.col("v") <= high).select("key", "name", "pos", F.when(F.col("v") >= low, F.col("v")).alias("v"))
            .groupBy("key", "name", "pos", "v").agg(F.count(F.lit(1)).alias("c")))
    up_to = Window.partitionBy("key", "name").orderBy(F.col("v").asc_nulls_first())
    cum = band.withColumn("cum", F.sum("c").over(up_to)).where(F.col("v").isNotNull())
    i, j = F.floor("pos"), F.ceil("pos")
    got = (cum.groupBy("key", "name", "pos")
           .agg(F.min(F.when(F.col("cum") > i, F.col("v"))).alias("a"), F.min(F.when(F.col("cum") > j, F.col("v"))).alias("z"))
           .withColumn("value", F.col("a") + (F.col("z") - F.col("a")) * (F.col("pos") - i)))
    return (got.groupBy("key").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
            .select("key.*", *names))
