"""Centroid clusters, rendezvous shards and importance resampling against brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ptrack.llm import clusters, common, resampling, shards

CLASH = ["row", "place", "shard", "slot", "bid", "score", "rank", "n", "a", "b", "c", "at", "tie", "cluster", "distance", "ids", "lo", "text_crc32", "n_words"]


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


# --- 11 ---------------------------------------------------------------------------

def test_hilbert_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = np.arange(1 << bits)
        cells = np.stack(np.meshgrid(*[side] * dims), -1).reshape(-1, dims)
        place = clusters.hilbert(cells, bits)
        assert (np.sort(place) == np.arange(len(cells))).all()
        path = cells[np.argsort(place)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()          # one step along one axis


def test_candidates_keep_ties_and_all_nearest():
    rng = np.random.default_rng(1)
    for _ in range(200):
        c = rng.integers(-9, 9, (12, 3))
        v = rng.integers(-9, 9, 3) + rng.integers(0, 4, (20, 3))
        near = clusters.candidates(v.min(0), v.max(0), c)
        d = ((v[:, None] - c) ** 2).sum(2)
        at, best = clusters.nearest(v, c[near])
        assert (near[at] == d.argmin(1)).all() and (best == d.min(1)).all()


def test_blocks_prune_on_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 64)) * 2
    v = [(i, (base[i % 40] + rng.standard_normal(64) * 0.02).tolist()) for i in range(8000)]
    blocks = clusters.blocks_of(spark.createDataFrame(v, "vec_id long, embedding array<double>"), 64, 256).collect()
    c = clusters.whole(base, 256)
    near = [len(clusters.candidates(*(np.frombuffer(r[k], "<i4").astype(np.int64) for k in ("lo", "hi")), c)) for r in blocks]
    assert sum(len(r.ids) for r in blocks) == 8000
    assert np.mean(near) < 16                                            # of 40


def lloyd(rows, count, rounds, dim, seed):
    v = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    h = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    cents = [e for _, e in sorted((((h(i), e), e) for i, e in v if i is not None), key=lambda x: x[0])[:count]]
    for r in range(rounds + 1):
        best = [min((sum((a - b) ** 2 for a, b in zip(e, c)), k) for k, c in enumerate(cents)) for _, e in v]
        if r < rounds:
            for k in range(len(cents)):
                own = [e for (_, e), b in zip(v, best) if b[1] == k]
                if own:
                    cents[k] = [sum(x) // len(own) for x in zip(*own)]
    per = Counter()
    for d, k in best:
        per[k] += d
    return Counter((i, k, d, per[k], sum(per.values()), hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(v, best))


def test_clusters(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((6, 5))
    rows = [(i, (base[i % 6] + 0.3 * rng.standard_normal(5)).tolist()) for i in range(150)]
    rows += [rows[3]] * 60 + [(1000 + i, rows[7][1]) for i in range(40)]                   # repeated rows, equal vectors
    rows += [(None, rows[0][1]), (2000, None), (2001, []), (2002, [1.0] * 4), (2003, [1.0, None, 0.0, 0.0, 0.0]), (2004, [float("nan")] * 5),
             (2005, [float("inf")] + [0.0] * 4), (2006, [0.0] * 5), (2007, [-1e-12] * 5), (2008, [1.0] * 6)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    for count, rounds in ((8, 5), (3, 0), (500, 2)):
        got = Counter(tuple(r) for r in clusters.clusters(df, count, rounds, dim=5).collect())
        assert got == lloyd(rows, count, rounds, 5, "2")
    assert clusters.clusters(df.limit(0), dim=5).count() == 0
    assert clusters.clusters(df.where("vec_id = 2004"), dim=5).columns == clusters.clusters(df, 2, 1, dim=5).columns
    with pytest.raises(Exception, match="squared distances"):
        clusters.clusters(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>"), dim=1).collect()


def test_empty_centroids_stay(spark):
    # the second of two equal centroids loses every tie
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, [1.0])], "vec_id long, embedding array<double>")
    got = clusters.clusters(df, 2, 5, dim=1).collect()
    assert {(r.cluster, r.distance) for r in got} == {(0, 0)}


# --- 12 ---------------------------------------------------------------------------

TEXTS = ["", None, "one", "é 中文 🙂", "x" * 300_000] + ["same text"] * 60


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(900)] + [(5, "x")] * 400 + [(None, "no id")] * 3
    return clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def owner(key, weights):
    bids = [math.log((int(hashlib.md5(f"{i}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 16 ** 13) / w if w > 0 else -math.inf for i, w in enumerate(weights)]
    return bids.index(max(bids))


def test_shard_report(documents):
    rows = shards.shard_report(documents).collect()
    assert len(rows) == documents.count()
    slots = defaultdict(list)
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard, r.law) == (owner(key, [1.0] * 16), owner(key, [1.0] * 17), "key")
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append((r.slot, (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size)))
    for own in slots.values():
        own.sort()
        assert [s for s, _ in own] == list(range(len(own))) and [k for _, k in own] == sorted(k for _, k in own)
    text = {(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()}
    want = {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in text}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == want
    assert shards.shard_report(documents.limit(0)).count() == 0


def test_weighted_shards_move_little(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    weights = [1.0, 2.0, 0.0, 3.0, 0.5]
    more = [1.0, 2.0, 0.0, 3.0, 0.5, 1.5]
    heavier = [1.0, 2.0, 0.0, 4.0, 0.5]
    got = keys.select("doc_id", *[shards.shard_of(F.col("doc_id").cast("string"), w).alias(n) for w, n in ((weights, "a"), (more, "b"), (heavier, "c"))]).toPandas()
    share = got.a.value_counts(normalize=True)
    assert 2 not in share.index and all(abs(share[i] - w / sum(weights)) < 0.02 for i, w in enumerate(weights) if w)
    assert set(got.b[got.a != got.b]) == {5} and abs((got.a != got.b).mean() - 1.5 / 8) < 0.02
    assert set(got.c[got.a != got.c]) == {3}
    assert [owner(str(i), weights) for i in range(300)] == got.a[:300].tolist()
    with pytest.raises(ValueError):
        shards.shard_of(F.lit("k"), [0.0])


def test_write_shards(spark, documents, tmp_path):
    folder = f"file://{tmp_path}/shards"
    slim = documents.select("doc_id", "text")
    shards.write_shards(slim, folder, [1.0, 1.0, 2.0], rows_per_file=50)
    back = spark.read.parquet(folder)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text) for r in slim.collect())
    assert all(r.shard == owner("" if r.doc_id is None else str(r.doc_id), [1.0, 1.0, 2.0]) for r in back.collect())
    per_file = back.groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in per_file) <= 50


def test_numbered(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), rng.choice([7, 7, 7, rng.randint(0, 50)])) for _ in range(700)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(4)
    got = common.numbered(df, [F.desc("v")], ["g"]).collect()
    for g in "xyz":
        own = sorted((r.number, r.v) for r in got if r.g == g)
        assert [n for n, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted((v for h, v in rows if h == g), reverse=True)
    alone = sorted((r.number, r.v) for r in common.numbered(df, ["v"]).collect())
    assert [n for n, _ in alone] == list(range(700)) and [v for _, v in alone] == sorted(v for _, v in rows)
    assert common.numbered(df.limit(0), ["v"]).count() == 0


# --- 13 ---------------------------------------------------------------------------

def reference_ranks(docs, target, percent, least, longest, buckets, seed):
    def feats(t):
        w = [x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]
        return len(w), [zlib.crc32(b" ".join(w[i:i + k])) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    own, aim = [feats(t) for _, t in docs], [feats(t) for t in target]
    s, t = Counter(b for _, f in own for b in f), Counter(b for _, f in aim for b in f)
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in s}
    out = []
    for (i, _), (n, f) in zip(docs, own):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        out.append((n, i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[0] >= least), key=lambda x: (-x[4], x[1] is None, x[1] or 0))
    drawn = able[:percent * len(able) // 100]
    ranks = Counter((*x[1:], k + 1) for k, x in enumerate(drawn))
    return ranks, Counter(x[1:] for x in out), len(able)


@pytest.mark.parametrize("longest,buckets,percent,least", [(1, 10_000, 10, 20), (3, 500, 35, 0), (2, 70_000, 100, 1)])
def test_importance_ranks(spark, longest, buckets, percent, least):
    rng = random.Random(8)
    pool = ["Alpha", "beta", "naïve", "中文", "x9", "GAMMA", "delta-y", "7", "İstanbul"] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 45)))) for i in range(250)]
    docs += [(5, docs[5][1])] * 7 + [(900, None), (901, ""), (902, " .,;\n"), (903, "w1 " * 5000), (None, "w2 " * 25), (904, "a\x7fb\x85c d " * 30)]
    target = ["Alpha beta w1 w2 gamma", None, "", "x9 x9 中文"]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, at int")
    got = resampling.importance_ranks(df, aim, percent, least, longest, buckets).collect()
    ranks, every, able = reference_ranks(docs, target, percent, least, longest, buckets, "2024")
    assert Counter(tuple(r)[:4] for r in got) == every
    assert Counter(tuple(r) for r in got if r.rank is not None) == ranks


def test_importance_ranks_on_little(spark):
    docs = clashing(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"))
    none = spark.createDataFrame([], "text string")
    got = {r.doc_id: (r.n_features, r.rank) for r in resampling.importance_ranks(docs, none).collect()}
    assert got == {1: (2, None), 2: (0, None)}
    assert {r.rank for r in resampling.importance_ranks(docs, none, percent=100, least_words=0).collect()} == {1, 2}
    assert resampling.importance_ranks(docs.limit(0), none).count() == 0
    assert resampling.resampled(docs, none, percent=50, least_words=0).columns == docs.columns


def test_select_finds_every_rank(spark, monkeypatch):
    rng = random.Random(9)
    keys = [(rng.choice([3, 3, 3, rng.randint(-5, 5)]), rng.randint(0, 3), i) for i in range(400)]
    table = common.stored(spark.createDataFrame(keys, "a long, b long, c long").repartition(5), "test-keys")
    for rank in (1, 2, 57, 200, 399, 400):
        assert resampling.select(table, rank) == sorted(keys)[rank - 1]
    with pytest.raises(ValueError):
        resampling.select(table, 401)
