"""Token ids in word-aligned Simple-8b files.

A file holds the ids of consecutive documents in blocks of whole documents, and after
them an index: per block the first word, the number of words, ids and documents; per
document its id and number of ids. A word has a selector in its top four bits and 60
bits of payload: so many ids of so many bits each, or one of two escapes: a single id
too wide for 30 bits, or a run of one id. Blocks are decoded selector by selector."""
from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ptrack.llm.common import file_system, parts, shared_folder, write_file
from ptrack.llm.tokens import encoder, text_runs

# Fixed values of the format: ids in a word, by selector 0 to 12; their bits are 60 // ids.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2)
WIDE, RUN = 13, 14
MAGIC = b"S8B1"
SHORTEST_RUN = 24
SELECTOR = np.full(COUNTS[0] + 1, WIDE)
SELECTOR[list(COUNTS)] = range(len(COUNTS))


def encode_block(ids: np.ndarray) -> np.ndarray:
    """64-bit words of the ids (0 to 2**60 - 1). The last word may have unused places."""
    v = np.asarray(ids, dtype=np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64)
    bits = np.zeros(n + 2 * COUNTS[0], np.uint8)
    bits[:n] = np.frexp(v.astype(np.float64))[1]
    takes = np.ones(n, np.uint8)
    widest, span = bits, 1                                   # most bits among `span` ids from here on
    for k in sorted(COUNTS):
        while 2 * span <= k:
            widest = np.maximum(widest[:-span], widest[span:])
            span *= 2
        most = np.maximum(widest[:n], widest[k - span:k - span + n])
        np.maximum(takes, (most <= 60 // k) * np.uint8(k), out=takes)
    chosen = SELECTOR[takes]
    takes = takes.astype(np.int64)
    change = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1, [n]])
    if np.diff(change).max() >= SHORTEST_RUN:
        left = np.repeat(change[1:], np.diff(change)) - np.arange(n)
        run = (left >= np.maximum(SHORTEST_RUN, takes + 1)) & (v < 1 << 32)
        chosen[run], takes[run] = RUN, np.minimum(left, (1 << 28) - 1)[run]
    at, steps = [], takes.tolist()
    i = 0
    while i < n:
        at.append(i)
        i += steps[i]
    at = np.array(at)
    sel = chosen[at]
    words = sel.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([v, np.zeros(COUNTS[0], np.uint64)])
    for s in np.unique(sel):
        mine = np.flatnonzero(sel == s)
        if s == WIDE:
            words[mine] |= v[at[mine]]
        elif s == RUN:
            words[mine] |= takes[at[mine]].astype(np.uint64) << np.uint64(32) | v[at[mine]]
        else:
            k = COUNTS[s]
            shift = (np.arange(k) * (60 // k)).astype(np.uint64)
            words[mine] |= np.bitwise_or.reduce(padded[at[mine][:, None] + np.arange(k)] << shift, axis=1)
    return words


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    body = words & np.uint64((1 << 60) - 1)
    takes = np.array([*COUNTS, 1, 0, 0])[sel]
    runs = sel == RUN
    takes[runs] = (body[runs] >> np.uint64(32)).astype(np.int64)
    start = np.cumsum(takes) - takes
    out = np.zeros(max(n, int(takes.sum())), np.uint64)
    for s in np.unique(sel):
        mine = np.flatnonzero(sel == s)
        if s == WIDE:
            out[start[mine]] = body[mine]
        elif s == RUN:
            for i in mine:
                out[start[i]:start[i] + takes[i]] = body[i] & np.uint64((1 << 32) - 1)
        else:
            k = COUNTS[s]
            bits = 60 // k
            shift = (np.arange(k) * bits).astype(np.uint64)
            out[start[mine][:, None] + np.arange(k)] = body[mine][:, None] >> shift & np.uint64((1 << bits) - 1)
    return out[:n]


class Writer:
    """Chunks of bytes of one file, block by block."""

    def __init__(self, block_ids: int):
        self.block_ids, self.blocks, self.doc_ids, self.lengths = block_ids, [], [], []
        self.open: list = []
        self.size, self.words, self.docs, self.ids = 0, 0, 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray):
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.open.append(ids)
        self.size += len(ids)
        self.docs += 1
        if self.size >= self.block_ids:
            yield self.close_block()

    def close_block(self) -> bytes:
        words = encode_block(np.concatenate(self.open)) if self.open else np.zeros(0, np.uint64)
        self.blocks.append((self.words, len(words), self.size, self.docs))
        self.words += len(words)
        self.ids += self.size
        self.open, self.size, self.docs = [], 0, 0
        return words.astype("<u8").tobytes()

    def index(self) -> bytes:
        null = np.array([d is None for d in self.doc_ids], dtype=np.uint8)
        body = b"".join([np.array(self.blocks, dtype="<i8").tobytes(),
                         np.array([d or 0 for d in self.doc_ids], dtype="<i8").tobytes(), null.tobytes(),
                         np.array(self.lengths, dtype="<i8").tobytes()])
        return body + struct.pack("<qq", len(self.blocks), len(self.doc_ids)) + MAGIC


def read_file(uri: str):
    """Blocks of a file: (document ids, numbers of ids, all ids in a row), one block in memory."""
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        end = f.size() - 20
        tail = f.read_at(20, end)
        if tail[16:] != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        blocks, docs = struct.unpack("<qq", tail[:16])
        at = end - blocks * 32 - docs * 17
        body = f.read_at(end - at, at)
        table = np.frombuffer(body, "<i8", blocks * 4).reshape(-1, 4)
        ids = np.frombuffer(body, "<i8", docs, blocks * 32)
        null = np.frombuffer(body, np.uint8, docs, blocks * 32 + docs * 8)
        lengths = np.frombuffer(body, "<i8", docs, blocks * 32 + docs * 9)
        d = 0
        for first, n_words, n_ids, n_docs in table.tolist():
            words = np.frombuffer(f.read_at(n_words * 8, first * 8), "<u8")
            names = [None if z else int(i) for i, z in zip(ids[d:d + n_docs], null[d:d + n_docs])]
            yield names, lengths[d:d + n_docs], decode_block(words, n_ids)
            d += n_docs


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None,
                      block_ids: int = 1 << 16) -> DataFrame:
    """Encode doc_id, text (null: empty) in ascending doc_id order, each document
    followed by end_id, into one file per range of doc_id. Returns the manifest
    (shard, path, n_docs, n_ids), written beside the files.

    Ties of doc_id go by text; a null doc_id comes first. An empty table gives no files."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-files")

    def write(batches):
        from pyspark import TaskContext
        task = TaskContext.get()
        shard, tok = task.partitionId(), encoder(vocabulary)
        uri, w, any_rows = f"{folder}/shard-{shard:06d}.s8b", Writer(block_ids), False

        def chunks():
            for b in batches:
                names = b.column(0).to_pylist()
                for lo, texts in text_runs(b.column(1)):
                    ids, per = tok.encode(texts)
                    for name, x in zip(names[lo:lo + len(texts)], np.split(ids, np.cumsum(per)[:-1])):
                        yield from w.add(name, np.append(x, np.uint32(end_id)))
            if w.open:
                yield w.close_block()
            yield w.index()

        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is not None:
            from itertools import chain
            batches = chain([first], batches)
            write_file(uri, chunks(), f"{task.stageId()}-{task.attemptNumber()}-{task.taskAttemptId()}")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [uri], "n_docs": [len(w.doc_ids)], "n_ids": [w.ids]},
                                             schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    manifest = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
                .repartitionByRange(parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
                .mapInArrow(write, "shard int, path string, n_docs long, n_ids long"))
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    spark = manifest.sparkSession
    # one row per file: its first place among all ids
    placed = manifest.withColumn("base", F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = base or 0
                for names, lengths, ids in read_file(path):
                    ends = np.cumsum(lengths)
                    raw = ids.astype("<u4")
                    crc = [zlib.crc32(x.tobytes()) for x in np.split(raw, ends[:-1])]
                    yield pa.RecordBatch.from_pydict({"doc_id": names, "start": at + ends - lengths, "n_tokens": lengths,
                                                      "ids_crc32": crc}, schema=schema)
                    at += int(ends[-1])

    return (placed.select("path", "base").repartitionByRange(parts(spark), "path")
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))
