"""Exact self-join of texts by the Jaccard similarity of their word shingles.

The prefix filter wants the shingles of a set in one order for all documents, rare ones
first. Document frequencies are counted by an index of shingles that is spread over all
tasks: map tasks send each shingle once per batch of documents (several documents of a
batch that share it count as one entry), and only shingles that two documents share come
back to the batch. Shingles of one document alone come first in any prefix and never match,
so most documents are settled there. The rest is joined on prefixes: equal sets are one,
sets of equal prefix and size are one group, group pairs pass the size and the position
filter, and members are verified on their shared shingles. As classes are asked for, pairs
that are linked by others already are not verified again: first every group meets the head
of a list, then, in lists that many classes share, each text some of the largest class.

Rows are the nodes, not ids: rows that share a doc_id with different texts have sets and
links of their own. A row's key is its place (partition, batch, place in the batch), given
once when its text is read.

Shingles are 48 bits of a 64-bit hash: two different ones of a pair of documents of a
thousand shingles fall together with a chance of 4e-9."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ptrack.llm.common import WordHashes, components, forget, kept, mix, pack, pack_sorted, parts, small, stored, unpack, unpack_sorted, words

BATCH_SHINGLES = 1_500_000
BATCH_DOCS = 60_000
DOC_BITS = 16                         # of a row's key: its place in the batch, BATCH_DOCS at most
BATCH_BITS = 26                       # of a row's key: the batch in its partition
BITS = 48
PARTS = 4                             # parts of the index for each shuffle partition
ROUNDS = 8                            # between the passes, at most
HEADS = 3                             # that a text is compared with in a round
BEFORE = 16                           # shingles of the prefix that an entry of the index knows before its own
CROWDED = 4                           # pairs of different classes in a list for each of its entries: more are worth a round
ROWS = "kind int, home long, key long, a binary, b binary, c binary"
SCHEMA = pa.schema([("kind", pa.int32()), ("home", pa.int64()), ("key", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
INDEX, DOCS, TOGETHER, BACK = range(4)
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct shingles of a text as sorted 48-bit numbers. Fewer words than `size` are one
    shingle; a text without words has none."""
    w = kept("shingles", WordHashes).of(words(text))
    if not len(w):
        return w
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h * STEP + w[i:len(w) - k + 1 + i])
    return np.unique(h >> np.uint64(64 - BITS))


def _rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r)) for r in rows], schema=SCHEMA)


def _send(home: int, ids: list, texts: list, sets: list, n_parts: int):
    """Rows of a batch: its documents with the hashes of their texts, the shingles that several
    of them share, and the index."""
    sizes = np.array([len(s) for s in sets], np.int64)
    slot = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(slot, kind="stable")
    slot, doc = slot[order], doc[order]
    start = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
    many = np.diff(np.append(start, len(slot)))
    together = np.repeat(many > 1, many)
    yield _rows([(DOCS, home, home, pack(np.array(ids, np.int64).view(np.uint64)), pack(sizes.astype(np.uint64)), pack(np.array(texts, np.int64).view(np.uint64))),
                 (TOGETHER, home, home, pack_sorted(slot[together]), pack(doc[together]), None)])
    slot, who = slot[start], np.where(many > 1, 0, doc[start] + 1)
    width = (1 << BITS) // n_parts + 1
    part = (slot // np.uint64(width)).astype(np.int64)
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    out, size = [], 0
    for s, e in zip(cut.tolist(), np.append(cut[1:], len(part)).tolist()):
        out.append((INDEX, home, int(part[s]), pack_sorted(slot[s:e]), pack(who[s:e]), pack(many[s:e])))
        size += e - s
        if size > 1_000_000:
            yield _rows(out)
            out, size = [], 0
    if out:
        yield _rows(out)


def _forward(shingle_words: int, n_parts: int):
    def run(batches):
        from pyspark import TaskContext
        home = TaskContext.get().partitionId() << BATCH_BITS
        ids, texts, sets, size = [], [], [], 0
        for b in batches:
            for i, text, h in zip(*[b.column(k).to_pylist() for k in range(3)]):
                s = shingles(text, shingle_words)
                ids.append(i)
                texts.append(h)
                sets.append(s)
                size += len(s)
                if size >= BATCH_SHINGLES or len(ids) >= BATCH_DOCS:
                    yield from _send(home, ids, texts, sets, n_parts)
                    home, ids, texts, sets, size = home + 1, [], [], [], 0
        if ids:
            yield from _send(home, ids, texts, sets, n_parts)
        forget()                     # the counts and joins after this run beside the idle workers
    return run


def _count(batches):
    """Document frequencies of the index; shared shingles go back to their batches."""
    held: dict = {}
    for b in batches:
        rows = list(zip(*[b.column(i).to_pylist() for i in range(6)]))
        through = [r for r in rows if r[0] != INDEX]
        if through:
            yield _rows(through)
        for r in rows:
            if r[0] == INDEX:
                held.setdefault(r[2], []).append((r[1], *r[3:]))
    while held:
        _, rows = held.popitem()
        slots = [unpack_sorted(r[1]) for r in rows]
        slot = np.concatenate(slots)
        home = np.repeat(np.arange(len(rows)), [len(s) for s in slots])
        who, many = np.concatenate([unpack(r[2]) for r in rows]), np.concatenate([unpack(r[3]) for r in rows])
        order = np.argsort(slot, kind="stable")
        slot, home, who, many = slot[order], home[order], who[order], many[order]
        start = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        run = np.diff(np.append(start, len(slot)))
        df = np.repeat(np.add.reduceat(many, start), run)
        keep = df > 1
        slot, home, who, df = slot[keep], home[keep], who[keep], df[keep]
        order = np.argsort(home, kind="stable")
        slot, home, who, df = slot[order], home[order], who[order], df[order]
        cut = np.searchsorted(home, np.arange(len(rows) + 1))
        out = [(BACK, r[0], 0, pack_sorted(slot[s:e]), pack(who[s:e]), pack(df[s:e])) for r, s, e in zip(rows, cut[:-1], cut[1:]) if e > s]
        if out:
            yield _rows(out)


def _home(percent: int):
    schema = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("n_shared", pa.int64()), ("same", pa.binary()),
                        ("prefix", pa.list_(pa.int64())), ("shared", pa.list_(pa.int64()))])

    def run(batches):
        import xxhash
        homes: dict = {}
        for b in batches:
            for kind, home, _, a, x, c in zip(*[b.column(i).to_pylist() for i in range(6)]):
                homes.setdefault(home, []).append((kind, a, x, c))
        while homes:
            home, rows = homes.popitem()
            ids, sizes, texts = next((unpack(r[1]).view(np.int64), unpack(r[2]).astype(np.int64), unpack(r[3]).view(np.int64)) for r in rows if r[0] == DOCS)
            nodes = (home << DOC_BITS) + np.arange(len(ids))
            slot, who, df = [], [], []
            for kind, a, x, c in rows:
                if kind == BACK:
                    slot.append(unpack_sorted(a)), who.append(unpack(x).astype(np.int64)), df.append(unpack(c).astype(np.int64))
            join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
            slot, who, df = join(slot, np.uint64), join(who, np.int64), join(df, np.int64)
            one = who > 0
            # shingles that several documents of the batch share: their frequency by the shingle
            order = np.argsort(slot[~one])
            known, known_df = slot[~one][order], df[~one][order]
            more, more_who = next((unpack_sorted(r[1]), unpack(r[2]).astype(np.int64)) for r in rows if r[0] == TOGETHER)
            df = np.concatenate([df[one], known_df[np.searchsorted(known, more)] if len(known) else np.zeros(0, np.int64)])
            slot, doc = np.concatenate([slot[one], more]).view(np.int64), np.concatenate([who[one] - 1, more_who])
            order = np.lexsort((slot, df, doc))
            slot, doc = slot[order], doc[order]
            cut = np.searchsorted(doc, np.arange(len(ids) + 1))
            shared_n = np.diff(cut)
            least = -(-percent * sizes // 100)                       # so much of itself a partner must share
            keep = sizes - least + 1 - (sizes - shared_n)            # shared shingles in the prefix
            prefix, shared, same = [None] * len(ids), [None] * len(ids), [None] * len(ids)
            for i in np.flatnonzero((keep > 0) & (sizes > 0)).tolist():
                mine = slot[cut[i]:cut[i + 1]]
                prefix[i] = mine[:keep[i]]
                shared[i] = np.sort(mine)
                if shared_n[i] == sizes[i]:
                    same[i] = xxhash.xxh3_128_digest(shared[i].tobytes())
            for s in range(0, len(ids), 5000):
                e = s + 5000
                yield pa.RecordBatch.from_arrays([pa.array(nodes[s:e]), pa.array(ids[s:e]), pa.array(texts[s:e]), pa.array(sizes[s:e]), pa.array(shared_n[s:e]), pa.array(same[s:e], pa.binary()),
                                                  pa.array(prefix[s:e], pa.list_(pa.int64())), pa.array(shared[s:e], pa.list_(pa.int64()))], schema=schema)
    return run


def shared_sets(docs: DataFrame, percent: int = 80, shingle_words: int = 5) -> DataFrame:
    """node (a key of the row), doc_id, text_hash, n_shingles, n_shared of every row; for those that may have a partner also
    `same` (equal for equal sets), `prefix` (shared shingles of the prefix, rare ones
    first) and `shared` (all shared shingles, sorted)."""
    n = parts(docs.sparkSession) * PARTS
    sent = docs.select("doc_id", "text", F.xxhash64("text")).where("doc_id is not null").mapInArrow(_forward(shingle_words, n), ROWS)
    back = sent.repartition(n, "key").mapInArrow(_count, ROWS)
    return stored(back.repartition(n, "home").mapInArrow(
        _home(percent), "node long, doc_id long, text_hash long, n_shingles long, n_shared long, same binary, prefix array<long>, shared array<long>"), "shared-sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough."""
    of = lambda k: sets.select(F.col("node").alias(k), F.col("shared").alias(f"s{k}"), F.col("n_shingles").alias(f"n{k}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def _group_sets(groups: DataFrame, member: DataFrame, reps: DataFrame) -> DataFrame:
    """node (of the group), n_shingles, shared: all shared shingles of a group's members."""
    one = reps.join(groups.where("members = 1").select(F.col("g").alias("node")), "node", "left_semi").select("node", "n_shingles", "shared")
    several = (groups.where("members > 1").select("g", F.col("n_shingles").alias("n")).join(member, "g").join(reps.select("node", "shared"), "node")
               .select("g", "n", F.explode("shared").alias("slot")).distinct())
    return one.unionByName(several.groupBy("g", "n").agg(F.collect_list("slot").alias("shared"))
                           .select(F.col("g").alias("node"), F.col("n").alias("n_shingles"), "shared"))


def _merged(listed: DataFrame, of_member: DataFrame, reps: DataFrame, percent: int) -> tuple[DataFrame, list]:
    """of_member (node, g, c) with fewer classes c, and the links (a, b) that joined them. Texts
    copied with many changes are often too far from the head of a list, but near to others of its
    class. In each round a text meets, of every list, one member of another class, another one each
    time: in turn of the class that holds most of the list, and of any class. Pairs grow with the
    lists, not with their squares. Rounds go on while the lists hold many pairs of different
    classes and two rounds make these fewer by a tenth."""
    joined, seen = [], []
    for turn in range(ROUNDS):
        lists = (listed.select("slot", "g").join(of_member, "g").groupBy("slot", "c")
                 .agg(F.count(F.lit(1)).cast("double").alias("k"), F.min(F.struct(F.xxhash64("node", "slot", F.lit(turn)).alias("h"), "node")).alias("m"))
                 .groupBy("slot").agg(F.count(F.lit(1)).alias("classes"), F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("alike"),
                                      F.max(F.struct("k" if turn % 2 == 0 else "m.h", "c", F.col("m.node").alias("head"))).alias("top")).where("classes > 1"))
        lists = stored(lists.select("slot", "n", ((F.col("n") * F.col("n") - F.col("alike")) / 2).alias("apart"), F.col("top.c").alias("other"), F.col("top.head").alias("head")), "lists")
        apart, n = lists.agg(F.sum("apart"), F.sum("n")).first()
        if apart is None or apart <= CROWDED * n or len(seen) > 1 and apart > 0.9 * seen[-2]:
            break
        seen.append(apart)
        shared = (listed.select("slot", "g").join(lists.select("slot", "other", "head"), "slot").join(of_member, "g").where("c <> other")
                  .groupBy("node", "head").agg(F.count(F.lit(1)).alias("k")))
        nearest = F.slice(F.sort_array(F.collect_list(F.struct("k", "head")), False), 1, HEADS)
        pairs = shared.groupBy("node").agg(F.explode(nearest).alias("s")).select(F.col("node").alias("a"), F.col("s.head").alias("b"))
        found = stored(_verified(pairs, reps, percent), "links")
        joined.append(found)
        c = lambda k: of_member.select(F.col("node").alias(k), F.col("c").alias(f"c{k}"))
        apiece = components(found.join(c("a"), "a").join(c("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        of_member = stored(of_member.join(apiece.withColumnRenamed("node", "c"), "c", "left").select("node", "g", F.coalesce("component", "c").alias("c")), "member-classes")
    return of_member, joined


def _classes(docs: DataFrame, percent: int, shingle_words: int) -> DataFrame:
    """doc_id, text_hash, n_shingles of every row with a doc_id, and `first`: the least (doc_id,
    text_hash) of the rows that links reach, null where nothing links."""
    sets = shared_sets(docs, percent, shingle_words)
    able = sets.where("prefix is not null")
    copies = able.where("same is not null").groupBy("same").agg(F.min("node").alias("b"))
    copies = stored(able.where("same is not null").select("node", "same").join(copies, "same").where("node <> b").select(F.col("node").alias("a"), "b"), "copies")
    reps = stored(able.join(copies.select(F.col("a").alias("node")), "node", "left_anti"), "sets")
    groups = stored(reps.groupBy("n_shingles", "n_shared", "prefix").agg(F.min("node").alias("g"), F.count(F.lit(1)).alias("members")), "prefix-groups")
    listed = groups.select("g", F.col("n_shingles").alias("n"), "prefix", F.posexplode("prefix").alias("pos", "slot"))
    listed = listed.withColumn("before", F.slice("prefix", F.greatest(F.col("pos") - BEFORE + 1, F.lit(1)), F.least("pos", F.lit(BEFORE)))).drop("prefix")
    shared_n = groups.select("g", (F.col("n_shingles") - F.col("n_shared")).alias("alone"))
    listed = stored(listed.join(shared_n, "g"), "prefix-index")
    member = stored(reps.alias("r").join(groups.alias("g"), ["n_shingles", "n_shared", "prefix"]).select("node", "g"), "members")

    def may(a: str, b: str, met=False):
        """Size and position filter of two entries of one shingle's list; met: of entries without a
        common one among the shingles just before."""
        left = F.least(*[F.col(f"{x}.n") - F.col(f"{x}.alone") - F.col(f"{x}.pos") - 1 for x in (a, b)])
        pa, pb, na, nb = F.col(f"{a}.pos"), F.col(f"{b}.pos"), F.col(f"{a}.n"), F.col(f"{b}.n")
        ahead = F.least(pa, pb, F.greatest(pa - BEFORE, F.lit(0)) + F.greatest(pb - BEFORE, F.lit(0))) if met else F.least(pa, pb)
        return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * (ahead + 1 + left) >= percent * (na + nb))

    # first pass: every group with the head of one list it shares most with, members with their group's first
    head = listed.groupBy("slot").agg(F.min(F.struct("g", "n", "alone", "pos")).alias("h"), F.count(F.lit(1)).alias("k")).where("k > 1").select("slot", "h.*")
    starred = (listed.alias("x").join(head.alias("h"), "slot").where((F.col("x.g") != F.col("h.g")) & may("x", "h"))
               .groupBy(F.col("x.g").alias("a"), F.col("h.g").alias("b")).agg(F.count(F.lit(1)).alias("k"))
               .groupBy("a").agg(F.max(F.struct("k", (-F.col("b")).alias("b"))).alias("m")).select("a", (-F.col("m.b")).alias("b")))
    inside = member.where("node <> g").select(F.col("node").alias("a"), F.col("g").alias("b"))
    near = stored(_verified(starred.unionByName(inside), reps, percent), "links").unionByName(copies)
    class_of = stored(components(near), "classes")

    # between the passes: where long lists still hold many classes, these meet first
    of_member = member.join(class_of, "node", "left").select("node", "g", F.coalesce("component", "node").alias("c"))
    of_member, joined = _merged(listed, stored(of_member, "member-classes"), reps, percent)

    # second pass: all other candidates, as far as members of two groups (or of one) are in different classes
    entry = stored(listed.join(of_member.select("g", "c").distinct(), "g"), "class-index")
    x, y = entry.alias("x"), entry.alias("y")
    once = (F.col("x.g") < F.col("y.g")) | ((F.col("x.g") == F.col("y.g")) & (F.col("x.c") < F.col("y.c")))
    # where one of the shingles just before is common as well, the pair meets there or cannot link
    later = F.arrays_overlap("x.before", "y.before")
    met = x.join(y, (F.col("x.slot") == F.col("y.slot")) & (F.col("x.c") != F.col("y.c")) & once & may("x", "y", met=True) & ~later)
    met = stored(met.select(F.col("x.g").alias("ga"), F.col("x.c").alias("ca"), F.col("y.g").alias("gb"), F.col("y.c").alias("cb")).distinct(), "met")
    # group pairs: what all members of a group hold bounds what any two have in common
    able = _verified(met.where("ga <> gb").select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct(), _group_sets(groups, member, reps), percent)
    able = stored(able, "group-pairs").select(F.col("a").alias("ga"), F.col("b").alias("gb"))
    met = met.where("ga = gb").unionByName(met.join(able, ["ga", "gb"], "left_semi"))
    of = lambda k: of_member.select(F.col("g").alias(f"g{k}"), F.col("node").alias(k), F.col("c").alias(f"c{k}"))
    rest = met.join(of("a"), ["ga", "ca"]).join(of("b"), ["gb", "cb"]).select("a", "b")
    more = stored(_verified(rest, reps, percent), "links")
    found = components(reduce(DataFrame.unionByName, joined, class_of.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))
    found = stored(found.join(sets.select("node", "doc_id", "text_hash"), "node"), "linked")
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    return sets.join(found.join(first, "component").select("node", "first"), "node", "left").select("doc_id", "text_hash", "n_shingles", "first")


def similar_classes(docs: DataFrame, percent: int = 80, shingle_words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the least doc_id reachable by links. Texts
    link if 100 * common shingles >= percent * all shingles of both; a text without words links
    with nothing. Rows that share a doc_id are linked by their texts only, like any others; rows
    without a doc_id have n_shingles and component_id null."""
    known = _classes(docs, percent, shingle_words).select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))
    none = docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return known.unionByName(none)


def one_of_each(docs: DataFrame, percent: int = 80, shingle_words: int = 5) -> DataFrame:
    """docs with one row of each class: that of the least doc_id, among rows of this id that of the
    least hash of the text, and of rows alike in both any one. Rows without words or doc_id stay."""
    rows = stored(_classes(docs.select("doc_id", "text"), percent, shingle_words).where("first is not null"), "class-rows")
    mine = F.struct("doc_id", "text_hash") == F.col("first")
    gone = stored(rows.where(~mine).select("doc_id", "text_hash").distinct(), "near-copies")
    again = stored(rows.where(mine).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated-rows")

    def of(listed: DataFrame, how: str) -> DataFrame:
        same = (F.col("d.doc_id") == F.col("l.doc_id")) & (F.xxhash64("d.text") == F.col("l.text_hash"))
        return docs.alias("d").join(small(listed).alias("l"), same, how)

    if again.isEmpty():
        return of(gone, "left_anti")
    return of(gone.unionByName(again), "left_anti").unionByName(of(again, "left_semi").dropDuplicates(["doc_id", "text"]))
