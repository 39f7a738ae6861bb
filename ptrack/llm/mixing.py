"""Mixing sources to target weights by iterative proportional fitting (raking).

Tokens are counted per cell (source, language, topic). Raking scales the cells' token
weights, none beyond the cell's tokens, until their sums over each margin meet the targets; a document is then kept with
the calibrated probability of its cell, by a hash of its id. Only cells are raked, in
window sums over one margin at a time; the documents are read twice and never shuffled,
but for the join with their cells."""
from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ptrack.llm.common import small, stored

MARGINS = ("source", "lang", "topic")
# Topics by what a text holds, in lower case, the first that fits; the rest is prose.
TOPICS = (("legal", ("license", "licence", "copyright")), ("access", ("password", "secret", "token", "api_key", "apikey", "akia")),
          ("contact", ("@",)), ("table", ("|",)), ("markup", ("###", "$$$", "%%%", "&&&", "***")))
BLANKS = " \t\n\x0b\x0c\r"
TOLERANCE = 1e-3                      # of its goal, what a margin's sum may be off
STEP = 4                              # rounds between two looks at that
AHEAD = 1.7                           # power of the factors of all rounds of a step but the last
IDLE = 3                              # looks without progress after which the goals count as out of reach
NONE = "(none)"


def topic(text: Column) -> Column:
    low, t = F.lower(text), F.lit("prose")
    for name, marks in reversed(TOPICS):
        t = F.when(reduce(Column.__or__, [F.contains(low, F.lit(m)) for m in marks]), name).otherwise(t)
    return t


def words(text: Column) -> Column:
    inner = F.trim(text, F.lit(BLANKS))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, "[\\x20\\x09-\\x0D]+")))


def uniform(doc_id: Column, seed: str) -> Column:
    """0 to 1 by the id, the same on every run and in every place."""
    h = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def with_cells(docs: DataFrame) -> DataFrame:
    """docs with __source, __lang, __topic (nulls as '(none)') and __tokens (words)."""
    text = F.coalesce("text", F.lit(""))
    own = {m: F.coalesce(F.col(m).cast("string"), F.lit(NONE)) if m in docs.columns else topic(text) if m == "topic" else F.lit(NONE) for m in MARGINS}
    return docs.select("*", *[own[m].alias(f"__{m}") for m in MARGINS], words(text).cast("long").alias("__tokens"))


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Target shares of a margin: its shares of tokens to a power below 1, scaled to 1."""
    per = cells.groupBy(margin).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("target"))
    return per.withColumn("target", F.col("target") / F.sum("target").over(Window.partitionBy(F.lit(1))))


def _level(total, bound: Column, free: Column, part: Window, order: list) -> Column:
    """The x for which the sum of least(bound, x * free) over a part is `total`. With rows in
    the order in which they reach their bound, taking the first j as full and the rest as not
    full gives at most x, and x for the right j: the greatest of all. Where all bounds together
    fall short, the last row is at its bound. Null where nothing is free."""
    full_at = F.when(free > 0, bound / free)
    first = part.orderBy(full_at.asc_nulls_last(), *[F.col(c).asc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    last = part.orderBy(full_at.desc_nulls_first(), *[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    full, rest = F.coalesce(F.sum(bound).over(first), F.lit(0.0)), F.sum(free).over(last)
    return F.when(free > 0, (total - full) / rest)


class RakingWarning(UserWarning):
    """Raking ended with sums that do not meet their goals."""


def _swept(w: DataFrame, margins: list, rounds: int, ahead: float = 1.0) -> DataFrame:
    """Cells (bound, free, g_ the goal of each margin) after so many rounds, with `miss`: the
    greatest relative distance of the cell's margin sums from their goals. All rounds but the
    last may go ahead of their goals (over-relaxation), which takes fewer rounds."""
    for k in range(rounds):
        for m in margins:
            own = Window.partitionBy(m)
            w = w.withColumn("x", _level(F.col(f"g_{m}"), F.col("bound"), F.col("free"), own, margins))
            factor = F.pow(F.max("x").over(own), F.lit(ahead if k < rounds - 1 else 1.0))
            w = w.withColumn("free", F.when(F.col("free") > 0, F.col("free") * factor).otherwise(0.0))
    off = F.lit(0.0)
    for m in margins:
        goal = F.col(f"g_{m}")
        off = F.greatest(off, F.when(goal > 0, F.abs(F.sum(F.least("bound", "free")).over(Window.partitionBy(m)) - goal) / goal))
    return w.withColumn("miss", off)


def _settled(w: DataFrame, margins: list) -> DataFrame:
    best, idle = float("inf"), 0
    while True:
        w = stored(_swept(w, margins, STEP, AHEAD if best < float("inf") else 1.0), "rake")
        miss = w.agg(F.max("miss")).first()[0] or 0.0
        if miss <= TOLERANCE:
            return w
        idle = 0 if miss < 0.98 * best else idle + 1
        best = min(best, miss)
        if idle == IDLE:
            warnings.warn(f"raking ends {miss:.3g} of a goal away, {TOLERANCE} wanted: the goals contradict each other on these cells", RakingWarning, stacklevel=3)
            return w


def rake(cells: DataFrame, targets: dict, rounds: int | None = None, budget: float | None = None) -> DataFrame:
    """cells (margins, tokens) with `weight`: token weights whose sums over the margins
    meet the targets (margin, target share), as far as the cells allow. Cells without
    tokens or without a target weigh nothing. Without `rounds` the sweeps go on until every
    sum is within `TOLERANCE` of its goal; goals that contradict each other cannot be reached,
    which shows in sums that come no closer: a RakingWarning then tells how far they are.

    With a budget also `rate`, the probability to keep a document, such that `budget` of all
    tokens is expected to be kept: no cell weighs more than its tokens. Cells at that bound stay
    in every sum, the others are scaled to meet it. Of a value whose target is more than its
    tokens all are wanted, and what is missing goes to the other values of the margin in
    proportion to their targets."""
    everything = Window.partitionBy(F.lit(1))
    w, able = cells, F.col("tokens") > 0
    for m, target in targets.items():
        w = w.join(target.withColumnRenamed("target", f"t_{m}"), m, "left")
        able = able & (F.coalesce(f"t_{m}", F.lit(0.0)) > 0)
    bound = F.lit(float("inf")) if budget is None else F.col("tokens").cast("double")
    w = w.withColumn("bound", F.when(able, bound).otherwise(0.0)).withColumn("free", F.when(able, F.col("tokens").cast("double")).otherwise(0.0))
    w = stored(w, "rake")
    kept = 1.0
    if budget is not None:
        tokens, most = w.agg(F.sum("tokens"), F.sum("bound")).first()
        kept = min(budget * (tokens or 0), most or 0.0)
    for m in targets:
        per = w.where("bound > 0").groupBy(m).agg(F.sum("bound").alias("cap"), F.max(f"t_{m}").alias("t"))
        x = F.max("x").over(everything)
        per = per.withColumn("x", _level(F.lit(float(kept)), F.col("cap"), F.col("t"), everything, [m]))
        w = w.join(per.select(m, F.least("cap", x * F.col("t")).alias(f"g_{m}")), m, "left")
    w = stored(w.drop(*[f"t_{m}" for m in targets]), "rake")
    if rounds is None:
        w = _settled(w, list(targets))
    else:
        for k in range(0, rounds, STEP):
            w = stored(_swept(w, list(targets), min(STEP, rounds - k)), "rake")
    least = F.least("bound", "free")
    w = w.withColumn("weight", F.when(F.sum(least).over(everything) > 0, least / F.sum(least).over(everything)).otherwise(0.0))
    if budget is not None:
        w = w.withColumn("rate", F.when(F.col("bound") > 0, F.least(F.lit(1.0), F.col("free") / F.col("bound"))).otherwise(0.0))
    return w.drop("x", "miss", "bound", "free", *[f"g_{m}" for m in targets])


def misses(raked: DataFrame, targets: dict) -> DataFrame:
    """(margin, value, target, share): of every value of the margins its target and its share
    of the tokens that raked cells are expected to keep."""
    out = None
    for m, target in targets.items():
        per = raked.groupBy(m).agg(F.sum("weight").alias("share")).join(target, m, "full")
        per = per.select(F.lit(m).alias("margin"), F.col(m).alias("value"), F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("share", F.lit(0.0)).alias("share"))
        out = per if out is None else out.unionByName(per)
    return out


def raked_cells(cut: DataFrame, budget: float, power: float, targets: dict | None = None) -> tuple[DataFrame, dict]:
    """Cells of a table that with_cells made, with weight and rate, and the targets they were raked to."""
    cells = stored(cut.groupBy(*[f"__{m}" for m in MARGINS]).agg(F.sum("__tokens").alias("tokens")), "cells")
    given = targets or {}
    goals = {f"__{m}": given[m].withColumnRenamed(m, f"__{m}") if m in given else tempered(cells, f"__{m}", power) for m in MARGINS}
    return rake(cells, goals, budget=budget), goals


def mix(docs: DataFrame, budget: float = 0.5, power: float = 0.5, seed: str = "mix", targets: dict | None = None) -> DataFrame:
    """docs with the margins __source, __lang, __topic, and __tokens, __rate and __sampled.

    targets: margin -> (margin, target) table with shares that add to 1; margins left out get
    their own shares to the power `power`. Targets beyond the tokens there are stay missed (no
    document is drawn twice): see `rake`, and `misses` for how far. Documents without words count as no tokens and are
    kept with the rate of their cell; an empty table stays empty. Every row is drawn by its
    doc_id, so repeated rows are kept or left together."""
    cut = with_cells(docs)
    names = [f"__{m}" for m in MARGINS]
    raked, _ = raked_cells(cut, budget, power, targets)
    cell_rates = stored(raked.select(*names, F.col("rate").alias("__rate")), "rates")
    return cut.join(small(cell_rates), names).withColumn("__sampled", uniform(F.col("doc_id"), seed) < F.col("__rate"))


def oracle_sql(budget: float = 0.5, power: float = 0.5, seed: str = "mix") -> str:
    """The same rule in DuckDB: goals, sweeps with their looks at the distance, rates. `tick` counts
    the steps of the recursion: STEP rounds over all margins, then a look, and so on."""
    t = "'prose'"
    for name, marks in reversed(TOPICS):
        t = f"CASE WHEN {' OR '.join(f"contains(lower(text), '{m}')" for m in marks)} THEN '{name}' ELSE {t} END"
    n = len(MARGINS)
    turn = STEP * n + 1
    names = ", ".join(MARGINS)
    targets = ", ".join(f"tg_{m} AS MATERIALIZED (SELECT {m}, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) OVER () AS t FROM cells GROUP BY {m})" for m in MARGINS)
    goals = ", ".join(f"""g_{m} AS MATERIALIZED (SELECT {m}, least(cap, max(x) OVER () * t) AS g FROM (SELECT {m}, cap, t, ((SELECT kept FROM aim)
        - coalesce(sum(cap) OVER (ORDER BY cap / t, {m} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(t) OVER (ORDER BY cap / t, {m} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x
      FROM (SELECT {m}, sum(tokens)::DOUBLE AS cap, any_value(t) AS t FROM w JOIN tg_{m} USING ({m}) GROUP BY {m})))""" for m in MARGINS)
    pick = lambda what: f"CASE (tick % {turn}) % {n} " + " ".join(f"WHEN {i} THEN {what.format(m=m)}" for i, m in enumerate(MARGINS)) + " END"
    off = ", ".join(f"CASE WHEN g_{m} > 0 THEN abs(sum(least(bound, free)) OVER (PARTITION BY {m}) - g_{m}) / g_{m} ELSE 0 END" for m in MARGINS)
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, {t} AS topic,
  len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS n_tokens FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents)),
cells AS MATERIALIZED (SELECT {names}, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL), {targets},
w AS MATERIALIZED (SELECT * FROM cells WHERE tokens > 0),
aim AS MATERIALIZED (SELECT least({budget} * sum(tokens), sum(tokens))::DOUBLE AS kept FROM w), {goals},
start AS MATERIALIZED (SELECT {names}, tokens::DOUBLE AS bound, {", ".join(f"g_{m}.g AS g_{m}" for m in MARGINS)} FROM w {" ".join(f"JOIN g_{m} USING ({m})" for m in MARGINS)}),
rake(tick, {names}, bound, free, {", ".join(f"g_{m}" for m in MARGINS)}, best, idle, ended) AS (
  SELECT 0, {names}, bound, bound, {", ".join(f"g_{m}" for m in MARGINS)}, 'inf'::DOUBLE, 0, false FROM start
  UNION ALL
  SELECT tick + 1, {names}, bound, CASE WHEN look THEN free WHEN free > 0 THEN free * pow(max(x) OVER (PARTITION BY own), ahead) ELSE 0 END,
    {", ".join(f"g_{m}" for m in MARGINS)}, CASE WHEN look THEN least(best, miss) ELSE best END,
    CASE WHEN NOT look THEN idle WHEN miss < 0.98 * best THEN 0 ELSE idle + 1 END,
    look AND (miss <= {TOLERANCE} OR (NOT miss < 0.98 * best AND idle + 1 = {IDLE})) FROM (
    SELECT *, CASE WHEN free > 0 THEN (goal - coalesce(sum(bound) OVER (PARTITION BY own ORDER BY full_at NULLS LAST, {names} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(free) OVER (PARTITION BY own ORDER BY full_at NULLS LAST, {names} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS x,
      CASE WHEN best < 'inf'::DOUBLE AND (tick % {turn}) // {n} < {STEP - 1} THEN {AHEAD} ELSE 1.0 END AS ahead, max(far) OVER () AS miss FROM (
      SELECT *, tick % {turn} = {turn - 1} AS look, {pick("{m}")} AS own, {pick("g_{m}")} AS goal, CASE WHEN free > 0 THEN bound / free END AS full_at,
        greatest({off}) AS far FROM rake WHERE NOT ended))),
r AS (SELECT {names}, least(1.0, free / bound) AS rate FROM rake WHERE ended UNION ALL SELECT {names}, 0.0 FROM cells WHERE tokens = 0)
SELECT doc_id, {names}, n_tokens, round(rate, 9) AS rate,
  ('0x' || substr(md5('{seed}' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < rate AS sampled FROM d JOIN r USING ({names})"""


def sampled(docs: DataFrame, budget: float = 0.5, power: float = 0.5, seed: str = "mix") -> DataFrame:
    """The rows of docs that are drawn, columns as before."""
    return mix(docs, budget, power, seed).where("__sampled").select(*docs.columns)
