"""Interpolated modified Kneser-Ney model of word pairs: counted in Spark, kept in files of
sorted hash arrays that workers map into memory.

Three passes over the texts. The first counts words; a word's id is its place among the
sorted hashes. The second counts pairs: the two ids make a 64-bit key, mixed by a function
that can be undone, so parts of equal key ranges are even however common a word is, and
only keys and counts are shuffled. From the distinct pairs follow, per word, how many words
it follows and how many follow it once, twice or more. The third pass scores. Nothing of the
model goes through the driver but the sizes of its parts and counts of counts."""
from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ptrack.llm.common import (WordHashes, file_system, kept, mix, pack, pack_sorted, parts, shared_folder, stored, unpack, unpack_sorted, words,
                               write_file)

FLUSH = 4_000_000                      # tokens that a task counts before it sends
BIG = 255                              # counts from here on are kept beside the array of bytes
END_WORD = b"\n"                       # no word holds a blank
ROWS = "kind int, part int, a binary, b binary, c binary, d binary"
SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), *[(c, pa.binary()) for c in "abcd"]])
PAIRS, FOLLOWERS, FOLLOWED, INFO = range(4)


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, (*r, *[None] * (6 - len(r))))) for r in rows], schema=SCHEMA)


def unmix(h: np.ndarray) -> np.ndarray:
    """The inverse of mix."""
    h = h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))
    h = h * np.uint64(0x319642B2D24D8EC3)
    h = h ^ (h >> np.uint64(27)) ^ (h >> np.uint64(54))
    h = h * np.uint64(0x96DE1B173F119089)
    return h ^ (h >> np.uint64(30)) ^ (h >> np.uint64(60))


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens in a row, number of tokens of each text); a text ends with its end token."""
    flat, many = [], []
    for t in texts:
        w = words(t)
        flat += w
        flat.append(END_WORD)
        many.append(len(w) + 1)
    return kept("language model", WordHashes).of(flat), np.array(many, np.int64)


def ranges(keys: np.ndarray, n: int, last: int):
    """(part, from, to) of sorted keys, dealt by equal ranges of 0 .. last."""
    width = last // n + 1
    part = (keys // np.uint64(width)).astype(np.int64)
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    return zip(part[cut].tolist(), cut.tolist(), np.append(cut[1:], len(part)).tolist())


def summed(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[start], np.add.reduceat(c, start)


def slices(texts: list, most: int = 4_000_000):
    from ptrack.llm.tokens import slices as by_size
    for lo, hi in by_size(texts, most):
        yield texts[lo:hi]


class Array:
    """A file of numbers of one kind, mapped into memory. A file that is not on a mounted
    disk is copied to the worker's own folder first, and that copy goes with the worker."""

    _maps: dict = {}

    def __new__(cls, uri: str, kind: str) -> np.ndarray:
        if (uri, kind) not in cls._maps:
            fs, path = file_system(uri)
            if fs.type_name != "local":
                import tempfile
                local = tempfile.NamedTemporaryFile(prefix="model-")
                with fs.open_input_stream(path) as f:
                    while chunk := f.read(1 << 24):
                        local.write(chunk)
                local.flush()
                cls._maps[uri] = local
                path = local.name
            cls._maps[uri, kind] = np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
        return cls._maps[uri, kind]


def _attempt() -> str:
    from pyspark import TaskContext
    t = TaskContext.get()
    return f"{t.stageId()}-{t.attemptNumber()}-{t.taskAttemptId()}"


def _grouped(batches, wanted=None):
    """Rows of a partition by part; yields batches of other kinds at once."""
    held: dict = {}
    for b in batches:
        other = []
        for r in zip(*[b.column(i).to_pylist() for i in range(6)]):
            if wanted is None or r[0] in wanted:
                held.setdefault(r[1], []).append(r)
            else:
                other.append(r)
        if other:
            yield _batch(other)
    while held:
        yield held.popitem()


# --- words ----------------------------------------------------------------------

class Vocabulary:
    """Words by id: parts of sorted hashes with counts, in the order of their ranges."""

    def __init__(self, folder: str, sizes: dict, n_parts: int):
        self.folder, self.n_parts = folder, n_parts
        self.first = np.concatenate([[0], np.cumsum([sizes.get(p, 0) for p in range(n_parts)])]).astype(np.int64)
        self.size = int(self.first[-1])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids or -1, counts) of sorted distinct hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for p, s, e in ranges(hashes, self.n_parts, (1 << 64) - 1):
            if self.first[p + 1] > self.first[p]:
                known = Array(f"{self.folder}/words-{p}", "<u8")
                at = np.minimum(np.searchsorted(known, hashes[s:e]), len(known) - 1)
                hit = known[at] == hashes[s:e]
                ids[s:e] = np.where(hit, at + self.first[p], -1)
                counts[s:e] = np.where(hit, Array(f"{self.folder}/counts-{p}", "<u8")[at].astype(np.int64), 0)
        return ids, counts


def count_words(docs: DataFrame, folder: str) -> tuple[Vocabulary, int]:
    """Word files of all texts, and how many tokens they have."""
    n = parts(docs.sparkSession)

    def send(batches):
        keys, counts, size = [], [], 0

        def out():
            k, c = summed(keys, counts)
            return _batch([(PAIRS, p, pack_sorted(k[s:e]), pack(c[s:e])) for p, s, e in ranges(k, n, (1 << 64) - 1)])

        for b in batches:
            for texts in slices(b.column(0).to_pylist()):
                k, c = np.unique(tokens(texts)[0], return_counts=True)
                keys.append(k), counts.append(c)
                size += len(k)
                if size > FLUSH:
                    yield out()
                    keys, counts, size = [], [], 0
        if keys:
            yield out()

    def merge(batches):
        for p, rows in _grouped(batches):
            k, c = summed([unpack_sorted(r[2]) for r in rows], [unpack(r[3]) for r in rows])
            write_file(f"{folder}/words-{p}", [k.astype("<u8").tobytes()], _attempt())
            write_file(f"{folder}/counts-{p}", [c.astype("<u8").tobytes()], _attempt())
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "n": [len(k)], "tokens": [int(c.sum())]})

    info = stored(docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(send, ROWS).repartition(n, "part")
                  .mapInArrow(merge, "part int, n long, tokens long"), "word-parts").collect()      # one row per part
    return Vocabulary(folder, {r.part: r.n for r in info}, n), sum(r.tokens for r in info)


# --- pairs ----------------------------------------------------------------------

def pair_ids(hashes: np.ndarray, many: np.ndarray, words_: Vocabulary) -> tuple:
    """(id before, id, count) of every token; before the first one stands the id `size`."""
    distinct, where = np.unique(hashes, return_inverse=True)
    ids, counts = words_.find(distinct)
    own = ids[where]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[np.cumsum(many) - many] = words_.size
    return before, own, counts[where]


def key_of(before: np.ndarray, own: np.ndarray) -> np.ndarray:
    return mix(before.astype(np.uint64) << np.uint64(32) | own.astype(np.uint64))


class Model:
    """What a worker needs to score: files of the parts, and the counts of counts."""

    def __init__(self, folder: str, words_: Vocabulary, n_tokens: int, n_docs: int, info: dict):
        self.folder, self.words, self.n_tokens, self.n_docs, self.n_parts = folder, words_, n_tokens, n_docs, words_.n_parts
        self.pair_parts = set(info["pair_parts"])
        self.word_parts = set(info["word_parts"])
        self.pairs = info["pairs"]                                  # distinct pairs
        self.discount = discounts(info["pair_counts"])
        self.discount_words = discounts(info["word_counts"])
        d, c = self.discount_words, info["word_counts"]
        self.rest = (d[1] * c[0] + d[2] * c[1] + d[3] * c[4]) / self.pairs if self.pairs else 1.0

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct pair keys."""
        out = np.zeros(len(keys), np.int64)
        for p, s, e in ranges(keys, self.n_parts, (1 << 64) - 1):
            if p not in self.pair_parts:
                continue
            known = Array(f"{self.folder}/pairs-{p}", "<u8")
            at = np.minimum(np.searchsorted(known, keys[s:e]), len(known) - 1)
            hit = known[at] == keys[s:e]
            c = np.where(hit, Array(f"{self.folder}/pair-counts-{p}", "u1")[at], 0).astype(np.int64)
            if (c == BIG).any():
                big = Array(f"{self.folder}/pair-big-{p}", "<u8").reshape(-1, 2)
                m = np.flatnonzero(c == BIG)
                c[m] = big[np.searchsorted(big[:, 0], at[m].astype(np.uint64)), 1]
            out[s:e] = c
        return out

    def of_words(self, ids: np.ndarray) -> np.ndarray:
        """Rows (followed by once, twice, more; follows) of sorted distinct ids."""
        out = np.zeros((len(ids), 4), np.int64)
        for p, s, e in ranges(ids.astype(np.uint64), self.n_parts, self.words.size):
            if p in self.word_parts:
                lo = p * (self.words.size // self.n_parts + 1)
                out[s:e] = Array(f"{self.folder}/about-words-{p}", "<u4").reshape(-1, 4)[ids[s:e] - lo]
        return out

    def score(self, hashes: np.ndarray, many: np.ndarray) -> tuple:
        """Per text: known tokens, base score, score."""
        before, own, count = pair_ids(hashes, many, self.words)
        v = self.words.size
        base = np.log10((count + 0.5) / (self.n_tokens + 0.5 * (v + 1)))
        distinct, where = np.unique(np.concatenate([before, own]), return_inverse=True)
        about = np.zeros((len(distinct), 4), np.int64)
        known = distinct >= 0
        about[known] = self.of_words(distinct[known])
        ctx, follows = about[where[:len(own)]], about[where[len(own):], 3]
        p = np.full(len(own), self.rest / (v + 1))
        if self.pairs:
            p += np.maximum(follows - self.discount_words[np.minimum(follows, 3)], 0) / self.pairs
        # counts of a word as what stands before: its own, for the start the number of texts
        first = np.cumsum(many) - many
        total = np.empty(len(own), np.int64)
        total[1:] = count[:-1]
        total[first] = self.n_docs
        both = np.flatnonzero((before >= 0) & (own >= 0))
        c = np.zeros(len(own), np.int64)
        keys, back = np.unique(key_of(before[both], own[both]), return_inverse=True)
        c[both] = self.lookup(keys)[back]
        seen = total > 0
        t = np.where(seen, total, 1)
        d = self.discount
        gamma = (ctx[:, 0] * d[1] + ctx[:, 1] * d[2] + ctx[:, 2] * d[3]) / t
        p = np.where(seen, np.maximum(c - d[np.minimum(c, 3)], 0) / t + gamma * p, p)
        return np.add.reduceat((count > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)


def discounts(n: list) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from how many counts are 1, 2, 3, 4."""
    n1, n2, n3, n4 = n[:4]
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *[min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1)]])


def _counts_of(c: np.ndarray) -> list:
    """How many counts are 1, 2, 3, 4, and 3 or more."""
    return [*[int((c == k).sum()) for k in (1, 2, 3, 4)], int((c >= 3).sum())]


def train(docs: DataFrame, folder: str | None = None) -> Model:
    """Model files of all texts of docs (null: empty), in a new shared folder unless one is given.
    Without texts all tokens are unknown and equally likely. At most 2**32 - 1 distinct words."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "language-model")
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    voc, n_tokens = count_words(docs, folder)
    if voc.size >= (1 << 32) - 1:
        raise ValueError("more distinct words than ids of 32 bits")
    n, v = voc.n_parts, voc.size

    def send(batches):
        keys, counts, size = [], [], 0

        def out():
            k, c = summed(keys, counts)
            return _batch([(PAIRS, p, pack_sorted(k[s:e]), pack(c[s:e])) for p, s, e in ranges(k, n, (1 << 64) - 1)])

        for b in batches:
            for texts in slices(b.column(0).to_pylist()):
                before, own, _ = pair_ids(*tokens(texts), voc)
                k, c = np.unique(key_of(before, own), return_counts=True)
                keys.append(k), counts.append(c)
                size += len(k)
                if size > FLUSH:
                    yield out()
                    keys, counts, size = [], [], 0
        if keys:
            yield out()

    def merge(batches):
        for p, rows in _grouped(batches):
            k, c = summed([unpack_sorted(r[2]) for r in rows], [unpack(r[3]) for r in rows])
            big = np.flatnonzero(c >= BIG)
            for name, a in (("pairs", k.astype("<u8")), ("pair-counts", np.minimum(c, BIG).astype("u1")),
                            ("pair-big", np.stack([big.astype("<u8"), c[big].astype("<u8")], axis=1))):
                write_file(f"{folder}/{name}-{p}", [a.tobytes()], _attempt())
            yield _batch([(INFO, p, pack(np.array([len(k), *_counts_of(c)])), b"pairs")])
            raw = unmix(k)
            before, own = raw >> np.uint64(32), raw & np.uint64((1 << 32) - 1)
            order = np.argsort(before, kind="stable")
            at, c = before[order], c[order]
            start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            per = [np.add.reduceat(m.astype(np.int64), start) for m in (c == 1, c == 2, c >= 3)]
            at = at[start]
            yield _batch([(FOLLOWERS, q, pack_sorted(at[s:e]), *[pack(x[s:e]) for x in per]) for q, s, e in ranges(at, n, v)])
            at, many = np.unique(own, return_counts=True)
            yield _batch([(FOLLOWED, q, pack_sorted(at[s:e]), pack(many[s:e])) for q, s, e in ranges(at, n, v)])

    def about(batches):
        width = v // n + 1
        for got in _grouped(batches, (FOLLOWERS, FOLLOWED)):
            if isinstance(got, pa.RecordBatch):
                yield got
                continue
            p, rows = got
            table = np.zeros((max(0, min(width, v + 1 - p * width)), 4), np.uint32)
            for kind, _, a, *cols in rows:
                at = (unpack_sorted(a) - np.uint64(p * width)).astype(np.int64)
                for j, x in enumerate(cols if kind == FOLLOWERS else cols[:1]):
                    table[at, j if kind == FOLLOWERS else 3] += unpack(x).astype(np.uint32)
            write_file(f"{folder}/about-words-{p}", [table.astype("<u4").tobytes()], _attempt())
            yield _batch([(INFO, p, pack(np.array([len(table), *_counts_of(table[:, 3])])), b"words")])

    sent = docs.mapInArrow(send, ROWS).repartition(n, "part").mapInArrow(merge, ROWS)
    info = stored(sent.repartition(n, "part").mapInArrow(about, ROWS), "model-parts").select("part", "a", "b").collect()   # two rows per part
    of = lambda what: [(r.part, unpack(bytes(r.a)).astype(np.int64)) for r in info if bytes(r.b) == what]
    total = lambda what: np.sum([x for _, x in of(what)], axis=0).tolist() if of(what) else [0] * 6
    return Model(folder, voc, n_tokens, docs.count(), {
        "pair_parts": [p for p, _ in of(b"pairs")], "word_parts": [p for p, _ in of(b"words")], "pairs": total(b"pairs")[0],
        "pair_counts": total(b"pairs")[1:], "word_counts": total(b"words")[1:]})


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    fields = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")],
                        *[(c, pa.float64()) for c in ("base_score", "score", "perplexity")]])

    def run(batches):
        for b in batches:
            ids, texts, at = b.column(0).to_pylist(), b.column(1).to_pylist(), 0
            for some in slices(texts):
                h, many = tokens(some)
                known, base, own = model.score(h, many)
                yield pa.RecordBatch.from_pydict({"doc_id": ids[at:at + len(some)], "n_tokens": many, "n_known": known,
                                                  "train_tokens": np.full(len(some), model.n_tokens), "base_score": base, "score": own,
                                                  "perplexity": 10 ** np.minimum(-own / many, 300)}, schema=schema)
                at += len(some)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, fields)


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of all texts by a model of those that are not held out. A row without doc_id is
    learnt from; repeated rows count as often as they are there."""
    model = train(docs.where(~held_out()))
    return score(docs, model).withColumn("held_out", held_out())
