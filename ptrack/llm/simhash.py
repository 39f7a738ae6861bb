"""SimHash fingerprints, and all pairs of fingerprints within a Hamming radius.

Words vote with their weight on 64 signed bits. Votes are added in lanes: a hash shifted
by k and masked gives bits k, k+16, k+32, k+48 in four 16-bit lanes of one long, so that
sixteen sums count all 64 bits. A lane cannot overflow, as votes are added by stretches
of a text first. Fingerprints within the radius share enough of their blocks, whichever
differ: one table for each choice of blocks, keyed by these, finds every pair."""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ptrack.llm.common import stored

BLANKS = "[\\x20\\x09-\\x0D]+"
LANES = 0x0001000100010001
STRETCH = 4096                       # words whose votes are added in 16-bit lanes: 4096 * 7 < 32768, as the top lane holds the sign
HEAVIEST = 7
BLOCKS = (13, 13, 13, 13, 12)         # bits of the blocks; more blocks make longer keys and more tables


def _weight() -> Column:
    """Short words say little: weight 1 up to three letters, then one more for each, at most 7."""
    return F.least(F.greatest(F.length("__word") - 2, F.lit(1)), F.lit(HEAVIEST)).cast("long")


def fingerprints(texts: DataFrame, keys: list) -> DataFrame:
    """keys, fp (long) of every row of `texts`, whose keys tell the rows apart. A text
    without words (or null) has fingerprint 0. Bit is 1 if its votes are over half."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), BLANKS), lambda w: w != "")
    each = (texts.select(*keys, F.posexplode_outer(words).alias("__pos", "__word"))
            .withColumn("__hash", F.xxhash64("__word")).withColumn("__weight", F.when(F.col("__word").isNull(), 0).otherwise(_weight()))
            .withColumn("__stretch", (F.col("__pos") / STRETCH).cast("int")))
    lane = [F.sum((F.shiftrightunsigned("__hash", k) if k else F.col("__hash")).bitwiseAND(F.lit(LANES)) * F.col("__weight")).alias(f"v{k}")
            for k in range(16)]
    some = each.groupBy(*keys, "__stretch").agg(F.sum("__weight").alias("total"), *lane)
    bits = [F.sum(F.shiftrightunsigned(f"v{b % 16}", 16 * (b // 16)).bitwiseAND(F.lit(0xFFFF))).alias(f"b{b}") for b in range(64)]
    votes = some.groupBy(*keys).agg(F.sum("total").alias("total"), *bits)
    fp = F.lit(0).cast("long")
    for b in range(64):
        value = (1 << b) if b < 63 else -(1 << 63)
        fp = fp.bitwiseOR(F.when(2 * F.col(f"b{b}") > F.col("total"), F.lit(value)).otherwise(F.lit(0)).cast("long"))
    return votes.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def near_pairs(fps: DataFrame, radius: int = 3, blocks: tuple = BLOCKS) -> DataFrame:
    """(a, b, distance) of all distinct fingerprints a < b at most `radius` bits apart, fewer
    than there are blocks. `radius` of the blocks may differ, so the other ones agree: a table for
    each choice of blocks, and a pair counts in the first table in which it meets."""
    keep = len(blocks) - radius
    ends = [sum(blocks[:i]) for i in range(len(blocks) + 1)]
    masks = [((1 << b) - 1) << a for a, b in zip(ends, blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    chosen = list(combinations(range(len(blocks)), keep))
    table = [sum(masks[i] for i in c) for c in chosen]
    each = fps.select("fp").distinct().select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in table])).alias("t", "key"))
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(signed(m))) == 0, F.lit(t)) for t, m in enumerate(table)])
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(x) <= radius) & (first == F.col("a.t"))
    return each.alias("a").join(each.alias("b"), on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"), F.bit_count(x).alias("distance"))


def near_counts(fps: DataFrame, radius: int = 3) -> DataFrame:
    """fp, n_near: how many rows of fps lie within the radius, itself not counted."""
    many = stored(fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "fingerprints")
    pairs = near_pairs(many, radius)
    both = pairs.select(F.col("a").alias("fp"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("fp"), F.col("a").alias("other")))
    beside = both.join(many.select(F.col("fp").alias("other"), "n"), "other").groupBy("fp").agg(F.sum("n").alias("beside"))
    return many.join(beside, "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("beside", F.lit(0))).alias("n_near"))


def successors(ids: DataFrame, column: str) -> DataFrame:
    """(column, next): the next lower value; after the least comes the greatest. Values are
    sorted by ranges; only the border of each range looks at the other ranges."""
    spark = ids.sparkSession
    ranged = stored(ids.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(
        int(spark.conf.get("spark.sql.shuffle.partitions")), column).withColumn("range", F.spark_partition_id()), "ranges")
    lower = F.lag(column).over(Window.partitionBy("range").orderBy(column))
    # one row per range
    tops = ranged.groupBy("range").agg(F.max(column).alias("top"))
    tops = tops.select("range", F.coalesce(F.lag("top").over(Window.orderBy("range")), F.max("top").over(Window.partitionBy(F.lit(1)))).alias("below"))
    return (ranged.withColumn("own", lower).join(F.broadcast(tops), "range")
            .select(column, F.coalesce("own", "below").alias("next")))


def edited_fingerprints(docs: DataFrame, radius: int = 3) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half of its code points
    replaced by as many first ones (or all) of the text of the next lower doc_id; after the
    least doc_id comes the greatest. near_*: likeness of the fingerprints, n_near: how many
    other rows have a fingerprint within the radius.

    Null texts are empty. Where rows share a doc_id, each is edited; the least of their texts
    and fingerprints stand for it as a next document. A row without doc_id is its own next."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), n.alias("n_chars"), "text", F.monotonically_increasing_id().alias("row"))
    own = stored(fingerprints(keyed, ["row", "doc_id", "h", "n_chars"]).drop("row"), "own-fingerprints")
    order = stored(successors(own, "doc_id"), "order")
    # what a document lends is cut before it is shuffled to the document that asks
    asked = order.join(own.groupBy("doc_id").agg(F.max(half).alias("asked")), "doc_id").select(
        F.col("doc_id").alias("for_id"), F.col("next").alias("doc_id"), "asked")
    lent = (docs.join(asked, "doc_id").select(F.col("for_id").alias("doc_id"), F.substr("text", F.lit(1), F.col("asked")).alias("lent"))
            .groupBy("doc_id").agg(F.min("lent").alias("lent")))
    heads = keyed.select("doc_id", "h", "n_chars", F.substr("text", F.lit(1), F.col("n_chars") - half).alias("head"),
                         F.when(F.col("doc_id").isNull(), F.substr("text", F.lit(1), half)).alias("mine"))
    text = F.concat("head", F.coalesce("mine", F.substr("lent", F.lit(1), half)))
    edited = (heads.join(lent, "doc_id", "left").select("doc_id", "h", text.alias("text"))
              .withColumn("edited_sha256", F.sha2("text", 256)).withColumn("row", F.monotonically_increasing_id()))
    edited = stored(fingerprints(edited, ["row", "doc_id", "h", "edited_sha256"]).drop("row").withColumnRenamed("fp", "edited_fp")
                    .dropDuplicates(["doc_id", "h"]), "edited-fingerprints")
    following = order.join(own.groupBy(F.col("doc_id").alias("next")).agg(F.min("fp").alias("next_fp")), "next").select("doc_id", "next_fp")
    near = near_counts(own.select("fp"), radius)
    all_ = (own.alias("o").join(edited.alias("e"), F.col("o.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("o.h") == F.col("e.h")))
            .select("o.*", "e.edited_sha256", "e.edited_fp").join(following, "doc_id", "left").join(near, "fp"))
    name = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return all_.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", name("fp").alias("fingerprint"),
                       name("edited_fp").alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                       likeness(F.col("fp"), F.coalesce("next_fp", "fp")).alias("near_next"), "n_near")
