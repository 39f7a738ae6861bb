"""Find the x, y, t and polarity columns of foreign event tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Accepted names, compared in lower case.
NAMES = {
    "x": ("x",),
    "y": ("y",),
    "t": ("t", "ts", "time", "timestamp", "timestamps"),
    "p": ("p", "pol", "polarity"),
}


def match_field(names: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First candidate that is a name, else the first name that starts with one."""
    low = {n.lower(): n for n in names}
    exact = [low[c] for c in candidates if c in low]
    if exact:
        return exact[0]
    return next((n for n in names if n.lower().startswith(tuple(candidates))), None)


def find_columns(names: Sequence[str]) -> dict[str, str | None] | None:
    """{x, y, t, p} -> name, or None unless x, y and t are there."""
    names = [n for n in names if not n.startswith("__")]
    got = {k: match_field(names, c) for k, c in NAMES.items()}
    return got if all(got[k] for k in "xyt") else None


def to_events(df: DataFrame, compat_float32: bool = False) -> DataFrame:
    """Rename and cast to the event schema; keeps event_idx if there is one."""
    got = find_columns([c for c in df.columns if c != "event_idx"])
    if got is None:
        raise ValueError(f"no x, y and t columns among {df.columns}")
    t = F.col(got["t"])
    t = t.cast("float").cast("double") if compat_float32 else t.cast("double")
    idx = F.col("event_idx") if "event_idx" in df.columns else F.monotonically_increasing_id()
    p = F.col(got["p"]).cast("int") if got["p"] else F.lit(None).cast("int")
    return df.select(idx.cast("bigint").alias("event_idx"), F.col(got["x"]).cast("int").alias("x"),
                     F.col(got["y"]).cast("int").alias("y"), t.alias("t"), p.alias("p"))


def from_positions(rows: DataFrame, width: int, compat_float32: bool = False) -> DataFrame:
    """Events from rows (event_idx, v array<double>) of a plain table: columns 0 and
    1 are x and y, polarity is the last column with values in {-1, 0, 1} only, time
    the first other one."""
    def v(i: int) -> Column:
        return F.col("v")[i]
    checks = [F.bool_and(F.isnan(v(i)) | v(i).isin(-1.0, 0.0, 1.0)).alias(f"c{i}") for i in range(2, width)]
    head = rows.agg(*checks).first()
    signs = [i for i in range(2, width) if head[f"c{i}"]]
    pol = signs[-1] if signs else None
    times = [i for i in range(2, width) if i != pol]
    if not times:
        raise ValueError("no time column")
    cols = [F.col("event_idx"), v(0).alias("x"), v(1).alias("y"), v(times[0]).alias("t")]
    return to_events(rows.select(*cols, *([v(pol).alias("p")] if pol is not None else [])), compat_float32)
