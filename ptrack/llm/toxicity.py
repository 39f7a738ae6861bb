"""Toxicity by FTRL-proximal logistic regression over hashed words, pairs and skip-pairs.

Each coordinate has a learning rate of its own, and L1 keeps all weights at zero that the
labels do not call for, so the weights are few, whatever the corpus. Shards of the labelled
sample learn side by side from the same state; their states are averaged after each pass.
The sample has a bounded size (`sample`), and the state at most one entry per coordinate."""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ptrack.llm.common import WordHashes, drop_file, kept, mix, read_file, released, shared_folder, stored, write_file
from ptrack.llm.tokens import slices

BITS = 21
ALPHA, BETA, L1, L2 = 3.0, 1.0, 2.0, 0.0
PASSES = 6
SHARDS = 4
SAMPLE = 20_000                      # labelled rows to learn from, in expectation
THRESHOLD = 0.7
LETTERS = re.compile(r"[^\W\d_]+")
# odd numbers that tell the kinds of features apart
WORD, PAIR, SKIP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def features(text: str | None) -> np.ndarray:
    """Coordinates of a text: the constant 0, and its words, pairs and skip-pairs, once each."""
    h = kept("toxicity", WordHashes).of(LETTERS.findall((text or "").lower()))
    kinds = [h * WORD, mix(h[:-1] * PAIR + h[1:]), mix(h[:-2] * SKIP + h[2:])]
    at = mix(np.concatenate(kinds)) >> np.uint64(64 - BITS)
    return np.concatenate([[0], np.unique(at[at > 0])]).astype(np.int32)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def learn(examples, z: np.ndarray, n: np.ndarray) -> None:
    """One pass over (coordinates, label) pairs, in place."""
    for at, y in examples:
        w = weights(z[at], n[at])
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
        g = p - y
        step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
        z[at] += g - step * w
        n[at] += g * g


def fit(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """labelled: doc_id, text, label (0 or 1), a sample of bounded size. Returns (coordinates,
    weights) that are not zero; without any row there are none."""
    spark = labelled.sparkSession
    schema = pa.schema([("shard", pa.int32()), ("key", pa.int64()), ("at", pa.binary()), ("label", pa.float64())])

    def featurise(batches):
        for b in batches:
            at = [features(t).tobytes() for t in b.column(1).to_pylist()]
            key = [(k * 0x9E3779B97F4A7C15 >> 8) & ((1 << 48) - 1) for k in (i or 0 for i in b.column(0).to_pylist())]
            yield pa.RecordBatch.from_pydict({"shard": [k % SHARDS for k in key], "key": key, "at": at, "label": b.column(2).cast(pa.float64())}, schema=schema)

    fields = "shard int, key long, at binary, label double"
    # rows of a shard in the order in which it learns them
    examples = stored(labelled.select("doc_id", "text", "label").mapInArrow(featurise, fields).repartition(SHARDS, "shard")
                      .sortWithinPartitions("shard", "key"), "examples")
    folder = shared_folder(spark, "toxicity-model")
    z, n = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    for k in range(PASSES):
        state = f"{folder}/pass-{k}"
        write_file(state, [z.tobytes(), n.tobytes()], "driver")          # two numbers for each coordinate

        def one_pass(batches):
            from pyspark import TaskContext
            task = TaskContext.get()
            kept("toxicity-fit", dict)                       # lets go of what other tasks remember
            held: dict = {}
            for b in batches:
                shards = b.column(0).to_numpy()
                for shard in np.unique(shards).tolist():
                    if shard not in held:
                        held[shard] = [x.astype(np.float64) for x in np.frombuffer(read_file(state), np.float32).reshape(2, -1)]
                    at = np.flatnonzero(shards == shard).tolist()
                    learn(((np.frombuffer(b.column(1)[i].as_buffer(), np.int32), b.column(2)[i].as_py()) for i in at), *held[shard])
            for shard in list(held):
                own_z, own_n = (x.astype(np.float32) for x in held.pop(shard))
                uri = f"{state}-{task.partitionId()}-{shard}"
                write_file(uri, [own_z.data, own_n.data], f"{task.taskAttemptId()}")
                yield pa.RecordBatch.from_pydict({"uri": [uri]})
            released()

        # the states of the shards are averaged one by one
        learnt = [r.uri for r in examples.select("shard", "at", "label").mapInArrow(one_pass, "uri string").collect()]
        sums = np.zeros((2, 1 << BITS))
        for uri in learnt:
            sums += np.frombuffer(read_file(uri), np.float32).reshape(2, -1)
        if learnt:
            z, n = (sums / len(learnt)).astype(np.float32)
        for uri in [state, *learnt]:
            drop_file(uri)
    z, n = z.astype(np.float64), n.astype(np.float64)
    w = weights(z, n)
    at = np.flatnonzero(w)
    return at.astype(np.int32), w[at]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], columns: list, name: str = "score") -> DataFrame:
    """columns of docs and the score, 0 to 1, from the whole text (null: empty)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    taken = docs.select(*columns, *([] if "text" in columns else ["text"]))
    place = taken.columns.index("text")

    def run(batches):
        w = np.zeros(1 << BITS)
        at, values = shared.value
        w[at] = values
        for b in batches:
            s = np.array([w[features(t)].sum() for t in b.column(place).to_pylist()])
            out = [*b.columns[:len(columns)], pa.array(1 / (1 + np.exp(-np.clip(s, -30, 30))))]
            yield pa.RecordBatch.from_arrays(out, names=[*columns, name])

    kinds = dict(taken.dtypes)
    return taken.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + f", `{name}` double")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def model_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Weights learnt from a sample of the labelled rows that are not held out. A doc_id with
    several labels is learnt with the greatest; a row without a doc_id is not learnt from."""
    known = (labels.select("doc_id", "toxic").where(~held_out()).where("doc_id is not null and toxic is not null")
             .groupBy("doc_id").agg(F.max("toxic").alias("label")))
    rate = min(1.0, sample / max(known.count(), 1))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    # about `sample` ids
    return fit(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels of held-out ids are never read."""
    return (score(docs, model_of(docs, labels, sample), ["doc_id"]).withColumn("held_out", held_out())
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")).select("doc_id", "held_out", "score", "predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, in one pass over the texts."""
    return score(docs, model_of(docs, labels, sample), docs.columns, "__score").where(F.col("__score") < threshold).drop("__score")
