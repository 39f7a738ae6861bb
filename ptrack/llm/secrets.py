"""Secrets in texts: spans of single patterns, and credentials whose parts are linked.

Positions of all matches of a pattern come from the lengths of what lies between them
(split) and of the matches themselves, summed along the text; only lengths are shuffled.
Weak parts (names of accounts, random-looking strings, addresses) are reported only if a
complementary part lies within the scope, whatever the length of both, found by an interval join on cells of the text.

Null texts count as empty; every input row gives one row, repeated ids included."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ptrack.llm.common import small, stored

# Kinds in order, their patterns, and what a match must have.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"               # same as runs of [0-9a-f] with 32 characters or more
IDENT = r"(?i)(user_?name|user_?id|login|client_?id|account|access_?key_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@_.-]+)"
RANDOM = r"[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"(https?|ftp|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9_.:/@%?&=~+-]+"
KINDS = ("assign", "access", "hex", "ident", "random", "endpoint")
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, IDENT, RANDOM, ENDPOINT)))
STRONG = ("assign", "access", "hex")
# What completes what: an identifier needs a secret, a secret an identifier or an endpoint, an endpoint a secret.
ROLE = {"assign": "secret", "hex": "secret", "random": "secret", "access": "ident", "ident": "ident", "endpoint": "endpoint"}
COMPLEMENTS = (("ident", "secret"), ("secret", "ident"), ("secret", "endpoint"), ("endpoint", "secret"))
SCOPE = 200


def _valid(kind: str, m: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8
    if kind == "access":
        return F.length(m) >= 16
    if kind == "ident":
        return F.length(F.regexp_extract(m, IDENT, 2)) >= 3
    if kind == "random":
        return m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
    return F.lit(True)


def _matches(text: Column, kind: str) -> Column:
    """Array of (kind, i, gap before, length, valid), empty without a match."""
    pattern = PATTERNS[kind]
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,valid:boolean>>")
    found = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
                       lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))
    # the piece after the last match has no match
    found = F.transform(F.filter(found, lambda x: x.m.isNotNull()), lambda x, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), x.gap.alias("gap"), F.length(x.m).alias("size"), _valid(kind, x.m).alias("valid")))
    return F.when(text.rlike(pattern), found).otherwise(none)


def pattern_spans(docs: DataFrame, keys: list) -> DataFrame:
    """keys, kind (place in KINDS), start, end of every valid match in `text`; a row of
    nulls for a text without one. Keys must tell the rows of docs apart."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select(*keys, F.concat(*[_matches(text, k) for k in KINDS]).alias("found"))
    each = found.select(*keys, F.explode_outer("found").alias("f")).select(*keys, "f.*")
    along = Window.partitionBy(*keys, "kind").orderBy("i")
    return (each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(along).cast("int"))
            .withColumn("start", F.col("end") - F.col("size"))
            .select(*keys, F.when(F.col("valid"), F.col("kind")).alias("kind"), "start", "end"))


def linked_spans(spans: DataFrame, keys: list, scope: int = SCOPE) -> DataFrame:
    """Adds `linked`: whether at most `scope` characters lie between it and a complementary
    part; parts that overlap have none between them. Interval join: a part is in all cells of
    the scope's width from its start to its end, and looks into those from `scope` before to
    `scope` behind it."""
    role = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLE[k])]), F.col("kind"))
    parts = spans.where("kind is not null").withColumn("role", role)

    def cells(start: Column, end: Column) -> Column:
        return F.explode(F.sequence(F.floor(start / scope), F.floor(end / scope)))

    needs = F.explode(F.array(*[F.struct(F.lit(a).alias("role"), F.lit(b).alias("need")) for a, b in COMPLEMENTS]))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    asks = parts.withColumn("n", needs).where("n.role = role").withColumn("near", cells(F.col("start") - scope, F.col("end") + scope))
    within = parts.select(*keys, "role", "start", "end", cells(F.col("start"), F.col("end")).alias("cell"))
    on = [*same, F.col("a.near") == F.col("b.cell"), F.col("a.n.need") == F.col("b.role"),
          F.greatest("a.start", "b.start") - F.least("a.end", "b.end") <= scope]
    linked = (asks.alias("a").join(within.alias("b"), on, "left_semi")
              .select(*keys, "kind", "start").distinct().withColumn("linked", F.lit(True)))
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"l.{k}")) for k in [*keys, "kind", "start"]]
    return (spans.alias("s").join(linked.alias("l"), on, "left")
            .select("s.*", F.coalesce("l.linked", F.lit(False)).alias("linked")))


def secret_spans(docs: DataFrame, keys: list, scope: int = SCOPE) -> DataFrame:
    """keys, kind, start, end: strong spans, and weak ones that are linked; a row with a
    null kind for a text without any."""
    spans = linked_spans(pattern_spans(docs, keys), keys, scope)
    strong = F.col("kind") < len(STRONG)
    return spans.withColumn("kind", F.when(strong | F.col("linked"), F.col("kind"))).select(*keys, "kind", "start", "end")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    keyed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    spans = secret_spans(keyed, ["row", "doc_id"])
    one = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))
    per = spans.groupBy("row", "doc_id").agg(
        *[F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k}") for i, k in enumerate(STRONG)],
        F.sort_array(F.collect_list(one)).alias("all"))
    base = F.filter("all", lambda s: s.kind < len(STRONG))
    return per.select("doc_id", *[f"n_{k}" for k in STRONG], F.sha2(_joined(base), 256).alias("base_sha256"),
                      _joined(F.col("all")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """docs with every reported span replaced by the mask in `text`, and `n_chars` to match;
    spans that overlap or touch become one mask. Columns and rows stay."""
    keyed = docs.withColumn("__h", F.xxhash64("text"))
    keys = ["doc_id", "__h"]
    spans = secret_spans(keyed.select(*keys, "text", F.monotonically_increasing_id().alias("row")), ["row", *keys], scope)
    spans = spans.where("kind is not null").select(*keys, "start", "end").distinct()
    along = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    spans = (spans.withColumn("new", F.when(F.col("start") > before, 1).otherwise(0))
             .withColumn("island", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
             .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("masks")))
    spans = small(stored(spans, "masks"), 1 << 18)
    both = keyed.alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.__h") == F.col("s.__h")), "left")
    text, masks = F.col("d.text"), F.col("s.masks")
    end_before = lambda i: F.when(i == 0, 0).otherwise(F.get(masks, i - 1).end)
    parts = F.transform(masks, lambda m, i: F.concat(F.substr(text, end_before(i) + 1, m.start - end_before(i)), F.lit(mask)))
    clean = F.concat(F.array_join(parts, ""), F.substr(text, F.element_at(masks, -1).end + 1))
    out = {c: F.col(f"d.{c}") for c in docs.columns}
    out["text"] = F.when(masks.isNull(), text).otherwise(clean)
    if "n_chars" in out:
        kind = dict(docs.dtypes)["n_chars"]
        out["n_chars"] = F.when(masks.isNull(), out["n_chars"]).otherwise(F.length(clean).cast(kind))
    return both.select(*[v.alias(k) for k, v in out.items()])
