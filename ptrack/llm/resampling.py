"""Importance resampling towards a target distribution, by hashed runs of words.

Documents become arrays of buckets, once. Counts of all buckets, in the documents and in the
target texts, give each bucket a gain; a document weighs the mean gain of its features. With
Gumbel noise from a hash of the id, the highest scores are a weighted draw without repeats.

The cutoff among the scores is found by weighted median-of-medians: each partition reports the
median of the keys it still holds, and how many. The median of these, weighted by the numbers,
has at least a quarter of all remaining keys on either side, so each round discards at least that
share, until the key of the wanted rank is met. Only the winners are sorted."""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ptrack.llm.common import kept, numbered, parts, stored

BUCKETS = 10_000
LONGEST = 1                          # words of the longest run
PERCENT = 10
LEAST_WORDS = 20
SEED = "2024"
HALF = 1 << 63
# bytes that part words become blanks, A-Z become small; bytes beyond ASCII belong to words
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


class Checksums(dict):
    """crc32 of words (bytes), remembered up to a bound."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        h = zlib.crc32(word)
        if len(self) < self.LIMIT:
            self[word] = h
        return h


def words(text: str | None) -> list:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def features(own: list, longest: int, buckets: int) -> np.ndarray:
    """Buckets of all runs of 1 to `longest` words, repeats counted."""
    sums = list(map(kept("resampling", Checksums).__getitem__, own))
    runs = [sums]
    for k in range(1, min(longest, len(own))):
        runs.append([zlib.crc32(b" " + w, c) for c, w in zip(runs[-1], own[k:])])
    flat = np.fromiter((c for r in runs for c in r), np.uint32, sum(map(len, runs))) if len(runs) > 1 else np.array(sums, np.uint32)
    return flat % np.uint32(buckets)


def featurised(texts: DataFrame, keys: list, longest: int, buckets: int) -> DataFrame:
    """keys, n_words, at (buckets of the features as packed integers) of every row; reads the texts once."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    taken = texts.select(*keys, F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            own = [words(t) for t in b.column(len(keys)).to_pylist()]
            at = [features(w, longest, buckets).astype(kind).tobytes() for w in own]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keys)], pa.array([len(w) for w in own], pa.int64()), pa.array(at, pa.binary())], names=[*keys, "n_words", "at"])

    kinds = dict(taken.dtypes)
    return taken.mapInArrow(run, "".join(f"`{k}` {kinds[k]}, " for k in keys) + "n_words long, at binary")


def _flat(column: pa.BinaryArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """All integers of a column of packed arrays, and where the array of each row begins and the last ends."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(kind) if raw.size else np.zeros(0, kind), (ends - ends[0]) // np.dtype(kind).itemsize


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket, over all rows. Tasks return sums, at most a row for each bucket."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches):
        n = np.zeros(buckets, np.int64)
        for b in batches:
            n += np.bincount(_flat(b.column(0), kind)[0], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bucket": at.astype(np.int64), "n": n[at]})

    out = np.zeros(buckets, np.int64)
    for r in rows.select("at").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n                                  # at most `buckets` rows
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(p / q)) of each bucket, with one added to every count."""
    n = len(own)
    s, t = own.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighted(rows: DataFrame, gain: np.ndarray, keys: list) -> DataFrame:
    """keys, n_words, n_features, weight (the floored mean gain; no features: 0)."""
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32
    taken = rows.select(*keys, "n_words", "at")

    def run(batches):
        for b in batches:
            at, ends = _flat(b.column(len(keys) + 1), kind)
            total = np.concatenate([[0], np.cumsum(gain[at])])[ends]
            n = np.diff(ends).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keys) + 1], pa.array(n), pa.array(np.diff(total) // np.maximum(n, 1))], names=[*keys, "n_words", "n_features", "weight"])

    kinds = dict(taken.dtypes)
    return taken.mapInArrow(run, "".join(f"`{k}` {kinds[k]}, " for k in keys) + "n_words long, n_features long, weight long")


# --- selection --------------------------------------------------------------------

KEY = ["a", "b", "c"]                # the order is by a, then b, then c; no two keys are equal


def _place(keys: np.ndarray, one: tuple) -> int:
    """How many of the sorted keys (rows of three) lie below one."""
    lo, hi = 0, len(keys)
    for j in range(3):
        column = keys[lo:hi, j]
        lo, hi = lo + int(np.searchsorted(column, one[j], "left")), lo + int(np.searchsorted(column, one[j], "right"))
    return lo


def _between(lo: tuple | None, hi: tuple | None):
    """Keys above lo and below hi."""
    cond = F.lit(True)
    for one, up in ((lo, True), (hi, False)):
        if one is not None:
            a, b, c = (F.col(k) for k in KEY)
            x, y, z = map(F.lit, one)
            cond = cond & ((a > x) | ((a == x) & ((b > y) | ((b == y) & (c > z)))) if up else (a < x) | ((a == x) & ((b < y) | ((b == y) & (c < z)))))
    return cond


def _weighted_median(medians: list) -> tuple:
    """medians: (key, weight). The first key at which half of the weight is reached."""
    total, so_far = sum(w for _, w in medians), 0
    for key, w in sorted(medians):
        so_far += w
        if 2 * so_far >= total:
            return key
    raise ValueError("nothing left to choose from")


def select(keys: DataFrame, rank: int) -> tuple:
    """The key of a rank (1: the least) among the rows (a, b, c long) of a stored table. The driver
    sees one row for each partition and round; a partition holds the keys it reads, sorted."""
    lo = hi = pivot = None
    size = left = keys.count()
    if not 1 <= rank <= size:
        raise ValueError("no such rank")
    while True:
        def report(batches, pivot=pivot):
            held = [np.column_stack([np.asarray(b.column(j), np.int64) for j in range(3)]) for b in batches]
            own = np.concatenate(held) if held else np.zeros((0, 3), np.int64)
            own = own[np.lexsort(own.T[::-1])]
            below = len(own) if pivot is None else _place(own, pivot)
            above = below + (0 if pivot is None else int(below < len(own) and tuple(own[below]) == pivot))
            halves = [own[:below], own[above:]]
            row = {"below": [below], "above": [len(own) - above], "met": [above - below]}
            for name, half in zip("xy", halves):
                for j, k in enumerate(KEY):
                    row[f"{name}{k}"] = [int(half[(len(half) - 1) // 2, j]) if len(half) else None]
            yield pa.RecordBatch.from_pydict(row, schema=schema)

        schema = pa.schema([(n, pa.int64()) for n in ("below", "above", "met", *[f"{x}{k}" for x in "xy" for k in KEY])])
        rows = keys.where(_between(lo, hi)).select(*KEY).mapInArrow(report, ", ".join(f"{n} long" for n in schema.names)).collect()
        below, met = sum(r.below for r in rows), sum(r.met for r in rows)
        if met and rank == below + met:
            return pivot
        if rank <= below:
            hi, left = pivot if pivot is not None else hi, below
            pivot = _weighted_median([((r.xa, r.xb, r.xc), r.below) for r in rows if r.below])
        else:
            lo, left, rank = pivot, sum(r.above for r in rows), rank - below - met
            pivot = _weighted_median([((r.ya, r.yb, r.yc), r.above) for r in rows if r.above])
        if left < size / 8:
            keys, size = stored(keys.where(_between(lo, hi)), "keys-left"), left


# --- operator ---------------------------------------------------------------------

def noise(doc_id, seed: str):
    """floor(1000 g) with Gumbel noise g from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def importance_ranks(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST,
                     buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs (doc_id, text); target has a
    column text. Of the N rows with at least `least_words` words, floor(percent N / 100) are drawn;
    rank counts them from 1 by score, ties by doc_id (null last), then in any order; others have none.

    Null and empty texts have no features and weight 0. A null doc_id is drawn by the hash of the
    empty id. Repeated rows count and are drawn each for themselves. Without target texts every
    bucket of the target is empty; an empty table gives no rows. Other columns are not read."""
    spark = docs.sparkSession
    rows = stored(featurised(docs, ["doc_id"], longest, buckets), "features")
    wanted = featurised(target, [], longest, buckets)
    gain = gains(bucket_counts(rows, buckets), bucket_counts(wanted, buckets))
    scored = weighted(rows, gain, ["doc_id"]).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scores")
    able = scored.where(F.col("n_words") >= least_words)
    n = able.count() * percent // 100
    if not n:
        return scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    own = [(-F.col("score")).alias("a"), F.coalesce("doc_id", F.lit(HALF - 1)).alias("b"), F.col("row").alias("c")]
    keys = stored(able.select(*own).repartition(parts(spark)), "keys")
    a, b, c = select(keys, n)
    keyed = scored.select("doc_id", "n_features", "weight", "score", "n_words", *own)
    drawn = (F.col("n_words") >= least_words) & ~_between((a, b, c), None)
    ranked = numbered(keyed.where(drawn), KEY, (), "rank").withColumn("rank", F.col("rank") + 1)
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*names).unionByName(keyed.where(~drawn).withColumn("rank", F.lit(None).cast("long")).select(*names))


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id is drawn, columns as before."""
    ids = stored(importance_ranks(docs, target, **options).where("rank is not null").select("doc_id").distinct(), "drawn")
    return docs.join(ids, "doc_id", "left_semi").select(*docs.columns)
