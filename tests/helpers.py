import numpy as np
import pandas as pd


def blobs(seed=0, particles=12, slices=12, dt=100.0, per=9, box=60, noise=20):
    """Random moving particles that meet, part and vanish, as an event table."""
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(particles):
        x, y = r.uniform(5, box, 2)
        u, v = r.uniform(-0.02, 0.02, 2)
        a, b = sorted(r.uniform(0, slices * dt, 2))
        for t in np.sort(r.uniform(a, b, max(2, int((b - a) / dt * per)))).round():
            rows.append((x + u * (t - a) + r.integers(-1, 2), y + v * (t - a) + r.integers(-1, 2), t))
    for _ in range(noise * slices):
        rows.append((*r.uniform(0, box, 2), float(r.integers(0, int(slices * dt)))))
    e = pd.DataFrame(rows, columns=["x", "y", "t"]).sort_values(["t", "x", "y"], ignore_index=True)
    e["x"], e["y"] = e.x.clip(0, 200).astype(int), e.y.clip(0, 200).astype(int)
    e.insert(0, "event_idx", np.arange(len(e)))
    return e


def to_spark(spark, e):
    return spark.createDataFrame(e).selectExpr("event_idx", "cast(x as int) x", "cast(y as int) y", "cast(t as double) t")


def flood(pixels, eight=False):
    """Labels of a set of pixels by flood fill, in raster order."""
    step = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (eight or not (i and j))]
    lab, n = {}, 0
    for p in sorted(pixels):
        if p in lab:
            continue
        n += 1
        todo = [p]
        lab[p] = n
        while todo:
            x, y = todo.pop()
            for i, j in step:
                q = (x + i, y + j)
                if q in pixels and q not in lab:
                    lab[q] = n
                    todo.append(q)
    return lab


def partition(rows):
    """Set of clusters as frozensets of (k, event_idx), whatever their ids."""
    out = {}
    for c, k, i in rows:
        out.setdefault(c, []).append((int(k), int(i)))
    return sorted(tuple(sorted(v)) for v in out.values())
