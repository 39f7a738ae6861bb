"""DuckDB statements that give the same results as the registered queries.

Each statement is put together from named WITH items; ``_sql`` pulls in what an
item needs."""
from __future__ import annotations

import re

from ptrack.fixtures import PIXEL_EVENTS_SQL

DT = "2000::DOUBLE"
# diag(Q), R and the start variances of the filter.
Q0, Q1, Q2, R = "2e-6::DOUBLE", "1::DOUBLE", "4e5::DOUBLE", "1::DOUBLE"

_ITEMS: dict[str, str] = {}
# read by several others: to be computed once
ONCE = {"trk", "shape", "shp2", "meds", "mads", "zed", "clip", "qs", "qual", "checked", "sl", "px", "dbscan", "chain", "dbx", "dbm", "rest", "clu1", "lab4", "pxo", "reg", "reg_w", "rgs", "rgk", "pwc", "pclu"}


def _item(name: str, body: str, cols: str = "") -> None:
    _ITEMS[name] = f"{name}{cols} AS {'MATERIALIZED ' if name in ONCE else ''}({body})"


def _sql(final: str) -> str:
    need: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for pair in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)|,\s*(\w+)\b", text):
            for n in pair:
                if n in _ITEMS and n not in seen:
                    seen.add(n)
                    visit(_ITEMS[n])
                    need.append(n)
    visit(final)
    return "WITH RECURSIVE " + ",\n".join([PIXEL_EVENTS_SQL.strip(), *(_ITEMS[n] for n in need)]) + "\n" + final


# --- slices and pixels
_item("bnd", f"""SELECT min(t) AS t0, max(t) AS t1,
  CAST(greatest(1, ceil((max(t) - min(t)) / {DT})) AS INTEGER) AS nn FROM pos""")
_item("ks", "SELECT CAST(unnest(range(0, nn)) AS INTEGER) AS k FROM bnd")
_item("sl", f"""SELECT p.*, k FROM pos p CROSS JOIN bnd JOIN ks
  ON p.t >= t0 + k * {DT} AND p.t <= t0 + (k + 1) * {DT}""")
_item("so", f"""SELECT p.*, k, p.t < t0 + k * {DT} AS is_overlap FROM pos p CROSS JOIN bnd JOIN ks
  ON p.t >= CASE WHEN k > 0 THEN t0 + (k - 0.4::DOUBLE) * {DT} ELSE t0 END AND p.t <= t0 + (k + 1) * {DT}""")
_item("px", "SELECT k, x, y, count(*) AS n, min((t, event_idx)) AS first FROM sl GROUP BY k, x, y")
_item("pxo", """SELECT k, x, y, count(*) AS n, count(*) FILTER (NOT is_overlap) AS n_in FROM so GROUP BY k, x, y""")


def _components(name: str, nodes: str, link: str) -> None:
    """Smallest raster code reachable from each node, for nodes (k, x, y)."""
    _item(f"{name}_e", f"""SELECT a.k, a.x * 720 + a.y AS a, b.x * 720 + b.y AS b FROM {nodes} a JOIN {nodes} b
      ON a.k = b.k AND {link}""")
    _item(f"{name}_r", f"""SELECT k, x * 720 + y AS c, x * 720 + y AS r FROM {nodes}
      UNION SELECT e.k, e.b, q.r FROM {name}_r q JOIN {name}_e e ON e.k = q.k AND e.a = q.c""", "(k, c, r)")
    _item(f"{name}_m", f"SELECT k, c, min(r) AS root FROM {name}_r GROUP BY k, c")


_components("cc4", "pxo", "abs(a.x - b.x) + abs(a.y - b.y) = 1")
_item("lab4", """SELECT k, c // 720 AS x, c % 720 AS y, dense_rank() OVER (PARTITION BY k ORDER BY root) AS label
  FROM cc4_m""")


def _match(name: str, src: str) -> None:
    _item(f"{name}_d", f"""SELECT a.k, a.label, b.label AS prev, sqrt((a.xm - b.xm) ** 2 + (a.ym - b.ym) ** 2) AS d
      FROM {src} a JOIN {src} b ON b.k = a.k - 1""")
    _item(f"{name}_p", f"""SELECT * FROM {name}_d WHERE d < 7.5
      QUALIFY row_number() OVER (PARTITION BY k, label ORDER BY d, prev) = 1""")
    _item(f"{name}_w", f"""SELECT * FROM {name}_p
      QUALIFY row_number() OVER (PARTITION BY k, prev ORDER BY d, label) = 1""")
    _item(name, f"""SELECT s.k, s.label, w.prev, w.d AS dist FROM {src} s
      LEFT JOIN {name}_w w ON w.k = s.k AND w.label = s.label""")


def _density(x: str, slices: str, min_pts: int) -> None:
    """Items {x}dbscan (labelled pixels), {x}dbm (medians), {x}chain (cluster ids) and
    {x}clu (events of clusters) of the events of ``slices``."""
    if x:
        _item(f"{x}px", f"SELECT k, x, y, count(*) AS n, min((t, event_idx)) AS first FROM {slices} GROUP BY k, x, y")
    _item(f"{x}core", f"""SELECT a.k, a.x, a.y, a.n, a.first, sum(b.n) AS neighbours, sum(b.n) >= {min_pts} AS core
      FROM {x}px a JOIN {x}px b ON a.k = b.k AND b.x BETWEEN a.x - 4 AND a.x + 4 AND b.y BETWEEN a.y - 4 AND a.y + 4
        AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 16 GROUP BY ALL""")
    _item(f"{x}corepx", f"SELECT * FROM {x}core WHERE core")
    _components(f"{x}dbs", f"{x}corepx", """b.x BETWEEN a.x - 4 AND a.x + 4 AND b.y BETWEEN a.y - 4 AND a.y + 4
      AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 16""")
    _item(f"{x}dbc", f"""SELECT c.k, c.x, c.y, m.root, min(c.first) OVER (PARTITION BY c.k, m.root) AS f
      FROM {x}corepx c JOIN {x}dbs_m m ON m.k = c.k AND m.c = c.x * 720 + c.y""")
    _item(f"{x}dbl", f"SELECT k, x, y, dense_rank() OVER (PARTITION BY k ORDER BY f) - 1 AS label FROM {x}dbc")
    _item(f"{x}dbscan", f"""SELECT p.k, p.x, p.y, p.n, CAST(coalesce(min(l.label), -1) AS BIGINT) AS label
      FROM {x}core p LEFT JOIN {x}dbl l ON l.k = p.k AND (CASE WHEN p.core THEN l.x = p.x AND l.y = p.y
        ELSE (l.x - p.x) * (l.x - p.x) + (l.y - p.y) * (l.y - p.y) <= 16 END)
      GROUP BY p.k, p.x, p.y, p.n""")
    _item(f"{x}dbm", f"""SELECT s.k, label, median(s.x) AS xm, median(s.y) AS ym, median(s.t) AS tm, count(*) AS events
      FROM {slices} s JOIN {x}dbscan d ON d.k = s.k AND d.x = s.x AND d.y = s.y WHERE label >= 0 GROUP BY s.k, label""")
    _match(f"{x}dbx", f"{x}dbm")
    _item(f"{x}chain", f"""SELECT k, label, CAST(k AS BIGINT) * 1048576 + label AS cluster_id FROM {x}dbx WHERE prev IS NULL
      UNION ALL SELECT x.k, x.label, c.cluster_id FROM {x}chain c JOIN {x}dbx x ON x.k = c.k + 1 AND x.prev = c.label""",
          "(k, label, cluster_id)")
    _item(f"{x}clu", f"""SELECT c.cluster_id, s.k, s.event_idx, s.x, s.y, s.t FROM {slices} s
      JOIN {x}dbscan d ON d.k = s.k AND d.x = s.x AND d.y = s.y JOIN {x}chain c ON c.k = d.k AND c.label = d.label""")


_density("", "sl", 7)
_item("used", "SELECT cluster_id, event_idx FROM clu")
# test mode: the first slice's events only
_item("slt", f"SELECT sl.* FROM sl, bnd WHERE t <= t0 + {DT}")
_density("t_", "slt", 7)
# second run: events left over by clusters of three slices and 20 events, slices twice as long
_item("clu1", """SELECT * FROM clu WHERE cluster_id IN
  (SELECT cluster_id FROM clu GROUP BY cluster_id HAVING count(DISTINCT k) >= 3 AND count(*) >= 20)""")
_item("rest", "SELECT * FROM pos WHERE event_idx NOT IN (SELECT event_idx FROM clu1)")
_item("ks2", f"SELECT CAST(unnest(range(0, CAST(greatest(1, ceil((t1 - t0) / (2 * {DT}))) AS INTEGER))) AS INTEGER) AS k FROM bnd")
_item("sl2", f"""SELECT p.*, k FROM rest p CROSS JOIN bnd JOIN ks2
  ON p.t >= t0 + k * 2 * {DT} AND p.t <= t0 + (k + 1) * 2 * {DT}""")
_density("r_", "sl2", 14)

# --- pixelwise tracking, region by region: regions that share a region of the slice before are
# taken one after the other, by label; all others of a slice in one step (wave 0)
_item("reg", """SELECT l.k, l.label, p.x, p.y, p.n, p.n_in FROM lab4 l JOIN pxo p ON p.k = l.k AND p.x = l.x AND p.y = l.y
  QUALIFY CASE WHEN l.k = 0 THEN count(*) OVER (PARTITION BY l.k, l.label) ELSE sum(p.n) OVER (PARTITION BY l.k, l.label) END >= 5""")
_item("reg_o", "SELECT DISTINCT a.k, a.label, b.label AS prev FROM reg a JOIN reg b ON b.k = a.k - 1 AND b.x = a.x AND b.y = a.y")
_item("reg_s", "SELECT DISTINCT a.k, a.label FROM reg_o a JOIN reg_o b ON a.k = b.k AND a.prev = b.prev AND a.label <> b.label")
_item("reg_w", """SELECT k, label, dense_rank() OVER (ORDER BY k, wave) AS step FROM (
  SELECT r.k, r.label, CASE WHEN s.label IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY r.k, s.label IS NULL ORDER BY r.label) END AS wave
  FROM (SELECT DISTINCT k, label FROM reg) r LEFT JOIN reg_s s ON s.k = r.k AND s.label = r.label)""")
_item("rgs", "SELECT w.step, r.* FROM reg r JOIN reg_w w ON w.k = r.k AND w.label = r.label")
_item("rgk", "SELECT DISTINCT step, k FROM reg_w")
# kinds: o live pixels of the slice before, c claimed in this slice, n claimed in this step, z keeps the recursion going
_item("pw", """SELECT 0::BIGINT, -1, 'z', NULL::BIGINT, NULL::INTEGER, NULL::INTEGER, NULL::BIGINT
  UNION ALL (WITH nk AS (SELECT step, k FROM rgk WHERE step = (SELECT max(step) + 1 FROM pw)),
    cur AS (SELECT CASE WHEN nk.k = pw.k AND kind <> 'o' THEN 'c' ELSE 'o' END AS kind, id, x, y, w FROM pw, nk
      WHERE kind <> 'z' AND (nk.k = pw.k OR (nk.k = pw.k + 1 AND kind <> 'o'))),
    r AS (SELECT g.* FROM rgs g JOIN nk ON g.step = nk.step),
    t AS (SELECT DISTINCT r.label, o.id FROM r JOIN cur o ON o.kind = 'o' AND o.x = r.x AND o.y = r.y
      WHERE o.id NOT IN (SELECT id FROM cur WHERE kind = 'c')),
    m AS (SELECT label, count(*) AS tracks, min(id) AS id FROM t GROUP BY label),
    c AS (SELECT label, t.id, cx, cy FROM t JOIN (SELECT id, sum(x * w)::DOUBLE / sum(w)::DOUBLE AS cx, sum(y * w)::DOUBLE / sum(w)::DOUBLE AS cy
      FROM cur WHERE kind = 'o' GROUP BY id) q ON q.id = t.id WHERE label IN (SELECT label FROM m WHERE tracks > 1)),
    lost AS (SELECT DISTINCT a.label, a.id FROM c a JOIN c b ON a.label = b.label AND a.id <> b.id
      WHERE sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) < 4),
    ctr AS (SELECT c.label, c.id, CASE WHEN l.id IS NULL THEN cx ELSE -1000 END AS cx, CASE WHEN l.id IS NULL THEN cy ELSE -1000 END AS cy
      FROM c LEFT JOIN lost l ON l.label = c.label AND l.id = c.id),
    near AS (SELECT r.k, r.label, r.x, r.y, r.n, ctr.id FROM r JOIN ctr ON ctr.label = r.label
      QUALIFY row_number() OVER (PARTITION BY r.x, r.y ORDER BY (r.x - cx) * (r.x - cx) + (r.y - cy) * (r.y - cy), ctr.id) = 1),
    found AS (SELECT r.k, m.id, r.x, r.y, r.n FROM r JOIN m ON m.label = r.label WHERE tracks = 1
      UNION ALL SELECT k, id, x, y, n FROM near QUALIFY sum(n) OVER (PARTITION BY label, id) >= 4
      UNION ALL SELECT k, id, x, y, n FROM (SELECT r.k, r.k::BIGINT * 1048576 + r.label AS id, r.x, r.y, r.n, sum(n_in) OVER (PARTITION BY r.label) AS own
        FROM r LEFT JOIN m ON m.label = r.label WHERE m.label IS NULL) WHERE k = 0 OR own > 5)
    SELECT step, k, kind, id, x, y, w FROM cur, nk
    UNION ALL SELECT nk.step, nk.k, 'n', id, x, y, CASE WHEN nk.k = 0 THEN 1 ELSE n END FROM found, nk
    UNION ALL SELECT step, k, 'z', NULL, NULL, NULL, NULL FROM nk)""", "(step, k, kind, id, x, y, w)")
_item("pwc", "SELECT k, x, y, id AS cluster_id FROM pw WHERE kind = 'n'")
_item("pclu", """SELECT c.cluster_id, s.k, s.event_idx, s.x, s.y, s.t FROM so s JOIN pwc c ON c.k = s.k AND c.x = s.x AND c.y = s.y
  WHERE NOT s.is_overlap""")

# --- truth clusters: the particle of an event is its cluster
_item("tr", "SELECT event_idx, pid AS cluster_id, x, y, t FROM pos")
_item("cen", """SELECT pid AS label, k, median(x) AS xm, median(y) AS ym, median(t) AS tm, count(*) AS events
  FROM sl GROUP BY pid, k""")
_match("nnm", "cen")
_item("num", """SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY t, event_idx) - 1 AS seq FROM tr""")
_item("span", "SELECT cluster_id, min(t) AS ts, max(t) AS te FROM tr GROUP BY cluster_id")
_item("init", f"""SELECT cluster_id, avg(x) AS x0, regr_slope(x, (t - ts) * 1e-6::DOUBLE) AS vx0,
    avg(y) AS y0, regr_slope(y, (t - ts) * 1e-6::DOUBLE) AS vy0
  FROM tr JOIN span USING (cluster_id)
  WHERE t < ts + floor(least(10, (te - ts) / {DT})) * {DT} GROUP BY cluster_id""")


def _kalman(name: str, samples: str, init: str, var: str, lead: bool) -> None:
    """Filter states after each sample; ``lead`` filters sample 0 as well."""
    first = f"""SELECT cluster_id, CAST({-1 if lead else 0} AS BIGINT) AS seq, x0 AS px, vx0 AS vx, 0::DOUBLE AS ax,
        y0 AS py, vy0 AS vy, 0::DOUBLE AS ay, {var} AS p00, 0::DOUBLE AS p01, 0::DOUBLE AS p02, {var} AS p11,
        0::DOUBLE AS p12, {var} AS p22 FROM {init}"""
    _item(f"{name}_s", f"""SELECT cluster_id, seq, t, x, y, coalesce(t - lag(t) OVER w, lead(t) OVER w - t, {DT})
        * 1e-6::DOUBLE AS d FROM {samples} WINDOW w AS (PARTITION BY cluster_id ORDER BY seq)""")
    _item(f"{name}_k", f"""{first} UNION ALL
      SELECT cluster_id, seq, X0 + k0 * ex, X1 + k1 * ex, X2 + k2 * ex, Y0 + k0 * ey, Y1 + k1 * ey, Y2 + k2 * ey,
        b00 - k0 * b00, b01 - k0 * b01, b02 - k0 * b02, b11 - k1 * b01, b12 - k1 * b02, b22 - k2 * b02 FROM (
      SELECT *, b00 / s AS k0, b01 / s AS k1, b02 / s AS k2, zx - X0 AS ex, zy - Y0 AS ey FROM (
      SELECT *, b00 + {R} AS s FROM (
      SELECT *, a00 + d * a01 + h * a02 + {Q0} AS b00, a01 + d * a02 AS b01, a02 AS b02,
        a11 + d * a12 + {Q1} AS b11, a12 AS b12, p22 + {Q2} AS b22 FROM (
      SELECT *, p00 + d * p01 + h * p02 AS a00, p01 + d * p11 + h * p12 AS a01, p02 + d * p12 + h * p22 AS a02,
        p11 + d * p12 AS a11, p12 + d * p22 AS a12, px + d * vx + h * ax AS X0, vx + d * ax AS X1, ax AS X2,
        py + d * vy + h * ay AS Y0, vy + d * ay AS Y1, ay AS Y2 FROM (
      SELECT z.cluster_id, z.seq, z.d, 0.5::DOUBLE * z.d * z.d AS h, z.x AS zx, z.y AS zy, q.* EXCLUDE (cluster_id, seq)
      FROM {name}_k q JOIN {name}_s z ON z.cluster_id = q.cluster_id AND z.seq = q.seq + 1)))))""",
          "(cluster_id, seq, px, vx, ax, py, vy, ay, p00, p01, p02, p11, p12, p22)")
    _item(name, f"""SELECT z.cluster_id, z.seq, z.t, px, vx, ax, py, vy, ay
      FROM {name}_k JOIN {name}_s z USING (cluster_id, seq) {"" if lead else "WHERE seq > 0"}""")


_kalman("kal", "num", "init", "1e9::DOUBLE", False)


def _interp(name: str, src: str, cols: list[str]) -> None:
    nxt = ", ".join(f"lead({c}) OVER w AS n_{c}" for c in ["t", *cols])
    val = ", ".join(f"{c} + f * (coalesce(n_{c}, {c}) - {c}) AS {c}" for c in cols)
    _item(f"{name}_l", f"SELECT *, {nxt} FROM {src} WINDOW w AS (PARTITION BY cluster_id ORDER BY seq)")
    _item(f"{name}_g", f"""SELECT *, coalesce((g * {DT} - t) / (n_t - t), 0) AS f FROM {name}_l,
      LATERAL (SELECT unnest(generate_series(CAST(ceil(t / {DT}) AS BIGINT), CAST(CASE WHEN n_t IS NULL
        THEN floor(t / {DT}) ELSE ceil(n_t / {DT}) - 1 END AS BIGINT))) AS g) u""")
    _item(name, f"SELECT cluster_id, g, g * {DT} AS t, {val} FROM {name}_g")


_S = ["px", "vx", "ax", "py", "vy", "ay"]
_interp("kgrid", "kal", _S)
_item("kpts", """SELECT cluster_id, g AS seq, t, px AS x, py AS y,
  vx AS u, vy AS v FROM kgrid""")


def _smooth(name: str, src: str, cols: list[str]) -> None:
    one = ", ".join(f"(coalesce(lag({c}) OVER w, {c}) + {c} + coalesce(lead({c}) OVER w, {c})) / 3 AS {c}" for c in cols)
    _item(f"{name}_1", f"SELECT cluster_id, seq, t, {one} FROM {src} WINDOW w AS (PARTITION BY cluster_id ORDER BY seq)")
    _item(name, f"SELECT cluster_id, seq, t, {one} FROM {name}_1 WINDOW w AS (PARTITION BY cluster_id ORDER BY seq)")


_smooth("ksm", "kpts", ["x", "y", "u", "v"])
_item("trk", "SELECT cluster_id, seq, t, x, y, u * 1e-6::DOUBLE AS u, v * 1e-6::DOUBLE AS v FROM ksm")

# --- centre series
_item("cser", """SELECT label AS cluster_id, k, tm AS t, xm AS x, ym AS y,
  row_number() OVER (PARTITION BY label ORDER BY tm) - 1 AS seq FROM cen""")
_item("cspan", "SELECT cluster_id, min(t) AS ts, max(t) AS te FROM cser GROUP BY cluster_id")
_item("cinit", f"""SELECT cluster_id, avg(x) AS x0, CASE WHEN min(t) = max(t) THEN avg(x) * avg(t) * 1e-6
      / ((avg(t) * 1e-6) ** 2 + 1) ELSE regr_slope(x, (t - ts) * 1e-6::DOUBLE) END AS vx0,
    avg(y) AS y0, CASE WHEN min(t) = max(t) THEN avg(y) * avg(t) * 1e-6
      / ((avg(t) * 1e-6) ** 2 + 1) ELSE regr_slope(y, (t - ts) * 1e-6::DOUBLE) END AS vy0
  FROM cser JOIN cspan USING (cluster_id)
  WHERE t <= ts + floor(least(4, (te - ts) / {DT})) * {DT} GROUP BY cluster_id""")
_kalman("ckal", "cser", "cinit", "5e9::DOUBLE", True)
_item("cpf_s", f"""SELECT cluster_id, seq, 0 AS sub, px, vx, ax, py, vy, ay, 0::DOUBLE AS h FROM ckal WHERE seq = 0
  UNION ALL SELECT cluster_id, seq, j, px, vx, ax, py, vy, ay, j * {DT} * 1e-6::DOUBLE FROM (
    SELECT cluster_id, seq + 1 AS seq, t, lead(t) OVER (PARTITION BY cluster_id ORDER BY seq) AS n_t,
      px, vx, ax, py, vy, ay FROM ckal),
    LATERAL (SELECT unnest(generate_series(1, CAST(round_even((n_t - t) / {DT}, 0) AS BIGINT))) AS j) u WHERE n_t IS NOT NULL""")
_item("cpf", f"""SELECT cluster_id, g, ts + g * {DT} AS t, px + h * vx + h * h / 2 * ax AS px, vx + h * ax AS vx, ax,
    py + h * vy + h * h / 2 * ay AS py, vy + h * ay AS vy, ay FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY seq, sub) - 1 AS g FROM cpf_s)
  JOIN cspan USING (cluster_id) WHERE g < trunc((te - ceil(ts / {DT}) * {DT}) / {DT}) + 1""")

# --- samples for splines and the correction
_item("med", "SELECT cluster_id, t, median(x) AS x, median(y) AS y FROM tr GROUP BY cluster_id, t")
_item("fitg", f"""SELECT cluster_id, g AS seq, g * {DT} AS t FROM (
  SELECT cluster_id, unnest(generate_series(CAST(ceil(ts / {DT}) AS BIGINT), CAST(ceil(te / {DT}) - 1 AS BIGINT))) AS g
  FROM span)""")
_item("corr", f"""SELECT cluster_id, seq, t, x - 0.8::DOUBLE * s * u / sp AS x, y - 0.8::DOUBLE * s * v / sp AS y FROM (
  SELECT k.*, sqrt(u * u + v * v) AS sp, (SELECT stddev_pop((-e.x * k.v + e.y * k.u) / sqrt(k.u * k.u + k.v * k.v))
    FROM tr e WHERE e.cluster_id = k.cluster_id AND e.t > k.t - 1000 AND e.t < k.t + 1000) AS s FROM kpts k)""")

# --- quality
_item("shape", f"""SELECT cluster_id, coalesce(avg(turn) * 180 / pi(), 0) AS angle,
    stddev_pop(speed) / (avg(speed) + 1e-8) AS velo, sum(leg) AS path FROM (
  SELECT cluster_id, abs(d - 2 * pi() * floor((d + pi()) / (2 * pi()))) AS turn, leg, speed FROM (
    SELECT cluster_id, atan2(v, u) - lag(atan2(v, u)) OVER w AS d,
      sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS leg, sqrt(u * u + v * v) AS speed
    FROM trk WINDOW w AS (PARTITION BY cluster_id ORDER BY seq))) GROUP BY cluster_id""")
_item("shp2", """SELECT *, 1 / (path / ((SELECT median(path) FROM shape) + 1e-8) + 1e-8) AS inv FROM shape""")
_item("meds", "SELECT median(angle) AS ma, median(velo) AS mv, median(inv) AS mi FROM shp2")
_item("mads", """SELECT median(abs(angle - ma)) AS da, median(abs(velo - mv)) AS dv, median(abs(inv - mi)) AS di
  FROM shp2, meds""")
_item("zed", """SELECT shp2.*, (angle - ma) / (da + 1e-8) AS z_angle, (velo - mv) / (dv + 1e-8) AS z_velo,
  (inv - mi) / (di + 1e-8) AS z_inv FROM shp2 CROSS JOIN meds CROSS JOIN mads""")
_item("clip", "SELECT *, greatest(z_angle, 0) AS ca, greatest(z_velo, 0) AS cv, CASE WHEN z_inv IS NOT NULL THEN greatest(z_inv, 0) END AS ci FROM zed")
_item("qs", """SELECT quantile_cont(ca, 0.95) AS qa, quantile_cont(cv, 0.95) AS qv, quantile_cont(ci, 0.95) AS qi FROM clip""")
_item("qual", """SELECT clip.*, ca / (qa + 1e-8) AS q_angle, cv / (qv + 1e-8) AS q_velo, ci / (qi + 1e-8) AS q_inv,
  ca / (qa + 1e-8) + cv / (qv + 1e-8) + ci / (qi + 1e-8) AS score FROM clip CROSS JOIN qs""")
_item("checked", "SELECT trk.*, score <= 2.0 AS ok FROM trk JOIN qual USING (cluster_id)")

# --- neighbourhood (radius 80 here: the particles start 38 px apart)
_item("nbp", f"""SELECT cluster_id, seq, x, y, u, v, atan2(v, u) AS a,
  CAST(floor((t - (SELECT min(t) FROM trk)) / (2 * {DT})) AS BIGINT) AS bin FROM trk""")
_item("pair", """SELECT p.cluster_id, p.seq, p.bin, p.u AS pu, p.v AS pv, p.a AS pa, q.cluster_id AS qc, q.seq AS qs, q.u, q.v, q.a,
  exp(-0.5 * ((p.x - q.x) ** 2 + (p.y - q.y) ** 2) / 6400) AS w
  FROM nbp p JOIN nbp q ON p.bin = q.bin AND p.cluster_id <> q.cluster_id
    AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 <= 6400""")
_item("nbn", """SELECT cluster_id, seq, (SELECT count(*) FROM pair q WHERE q.cluster_id = p.cluster_id AND q.seq = p.seq) AS n_neighbors,
  (SELECT coalesce(sum(w), 0) FROM pair q WHERE q.cluster_id = p.cluster_id AND q.seq = p.seq) AS w_sum FROM nbp p""")
_item("pairs", "SELECT * FROM pair JOIN (SELECT cluster_id, seq FROM nbn WHERE n_neighbors >= 3) USING (cluster_id, seq)")


def _wmed(name: str, src: str, val: str, out: str) -> None:
    _item(f"{name}_c", f"""SELECT cluster_id, seq, {val} AS val, sum(w) OVER (PARTITION BY cluster_id, seq ORDER BY {val}, qc, qs) AS cw,
      sum(w) OVER (PARTITION BY cluster_id, seq) AS tw FROM {src}""")
    _item(name, f"SELECT cluster_id, seq, min(val) AS {out} FROM {name}_c WHERE cw >= 0.5 * tw GROUP BY cluster_id, seq")


_wmed("mu", "pairs", "u", "med_u")
_wmed("mv", "pairs", "v", "med_v")
_item("pmu", "SELECT pairs.*, med_u, abs(u - med_u) AS du FROM pairs JOIN mu USING (cluster_id, seq)")
_item("pmv", "SELECT pairs.*, med_v, abs(v - med_v) AS dv FROM pairs JOIN mv USING (cluster_id, seq)")
_wmed("du", "pmu", "du", "mad_u")
_wmed("dv", "pmv", "dv", "mad_v")
_item("cost", """SELECT a.cluster_id, a.seq, a.qc, a.qs, a.a,
    sum(b.w * abs(a.a - b.a - 2 * pi() * floor((a.a - b.a + pi()) / (2 * pi())))) AS c
  FROM pairs a JOIN pairs b USING (cluster_id, seq) GROUP BY a.cluster_id, a.seq, a.qc, a.qs, a.a""")
_item("medo", """SELECT cluster_id, seq, a AS med_angle FROM cost
  QUALIFY row_number() OVER (PARTITION BY cluster_id, seq ORDER BY round(c, 10), qc, qs) = 1""")
_item("pma", """SELECT pairs.*, med_angle, abs(a - med_angle - 2 * pi() * floor((a - med_angle + pi()) / (2 * pi()))) AS da
  FROM pairs JOIN medo USING (cluster_id, seq)""")
_wmed("da", "pma", "da", "mad_angle")
_item("nb", """SELECT n.cluster_id, n.seq, n_neighbors, w_sum, med_u, mad_u, med_v, mad_v, med_angle, mad_angle,
    CASE WHEN n_neighbors < 3 THEN 0 ELSE greatest(
      CASE WHEN mad_u = 0 THEN 0 ELSE abs(u - med_u) / (1.4826 * mad_u) END,
      CASE WHEN mad_v = 0 THEN 0 ELSE abs(v - med_v) / (1.4826 * mad_v) END) END AS comp_dev,
    CASE WHEN n_neighbors < 3 OR mad_angle = 0 THEN 0 ELSE
      abs(a - med_angle - 2 * pi() * floor((a - med_angle + pi()) / (2 * pi()))) / (1.4826 * mad_angle) END AS dir_dev
  FROM nbn n JOIN nbp USING (cluster_id, seq) LEFT JOIN mu USING (cluster_id, seq) LEFT JOIN mv USING (cluster_id, seq)
  LEFT JOIN du USING (cluster_id, seq) LEFT JOIN dv USING (cluster_id, seq) LEFT JOIN medo USING (cluster_id, seq)
  LEFT JOIN da USING (cluster_id, seq)""")

# --- pseudo-frames
_item("offs", """SELECT i, j FROM (SELECT unnest(range(-3, 4)) AS i) a, (SELECT unnest(range(-3, 4)) AS j) b
  WHERE i * i + j * j <= 9""")
_item("disc", """SELECT k, x + i AS x, y + j AS y, CAST(count(*) AS INTEGER) AS hits FROM px CROSS JOIN offs
  WHERE x + i BETWEEN 0 AND 1279 AND y + j BETWEEN 0 AND 719 GROUP BY ALL""")
_item("hv", """SELECT k, hits / 29::DOUBLE AS v, count(*) AS n FROM disc GROUP BY ALL
  UNION ALL SELECT k, 0::DOUBLE, 921600 - count(*) FROM disc GROUP BY k""")
_item("hb", """SELECT k, b, CAST(sum(n) AS DOUBLE) AS n, (b + 0.5) * any_value(hi) / 256 AS c FROM (
    SELECT k, n, hi, least(255, floor(v / (hi / 256))) AS b FROM hv JOIN (SELECT k, max(v) AS hi FROM hv GROUP BY k) USING (k))
  GROUP BY k, b""")
_item("hs", """SELECT k, b, c, sum(n) OVER w AS w1, sum(n * c) OVER w AS s1, sum(n) OVER (PARTITION BY k) AS w0,
  sum(n * c) OVER (PARTITION BY k) AS s0 FROM hb WINDOW w AS (PARTITION BY k ORDER BY b)""")
_item("otsu", """SELECT k, c AS threshold FROM hs WHERE w1 < w0
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY w1 * (w0 - w1) * (s1 / w1 - (s0 - s1) / (w0 - w1)) ** 2 DESC, b) = 1""")
_item("smo", "SELECT k, x, y FROM disc JOIN otsu USING (k) WHERE hits / 29::DOUBLE > threshold")
_components("cc8", "smo", "b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1")
_item("lab8", """SELECT k, CAST(c // 720 AS INTEGER) AS x, CAST(c % 720 AS INTEGER) AS y,
  dense_rank() OVER (PARTITION BY k ORDER BY root) AS label FROM cc8_m""")
_item("props", "SELECT k, label, count(*) AS area, avg(x) AS xm, avg(y) AS ym FROM lab8 GROUP BY k, label")

# --- fragments of five slices, for the repair
_item("frag", f"""SELECT cluster_id * 4096 + CAST(floor(t / (5 * {DT})) AS BIGINT) AS cluster_id, event_idx, x, y, t FROM tr""")
_item("fspan", "SELECT cluster_id, min(t) AS ts, max(t) AS te FROM frag GROUP BY cluster_id")
_item("fends", f"""SELECT cluster_id, ts, te, median(x) FILTER (t < ts + {DT}) AS xs, median(y) FILTER (t < ts + {DT}) AS ys,
    median(x) FILTER (t > te - {DT}) AS xe, median(y) FILTER (t > te - {DT}) AS ye
  FROM frag JOIN fspan USING (cluster_id) GROUP BY cluster_id, ts, te""")
_item("fcen", f"""SELECT cluster_id, CAST(floor(t / {DT}) AS INTEGER) AS k, median(x) AS xm, median(y) AS ym, median(t) AS tm
  FROM frag GROUP BY ALL""")
_item("fcends", """SELECT cluster_id, min(tm) AS ts, max(tm) AS te, arg_min(xm, tm) AS xs, arg_min(ym, tm) AS ys,
  arg_max(xm, tm) AS xe, arg_max(ym, tm) AS ye FROM fcen GROUP BY cluster_id""")

# Greedy links in the order (target, source), one candidate per step
_item("cands", f"""SELECT a.cluster_id AS target, b.cluster_id AS source,
    row_number() OVER (ORDER BY a.cluster_id, b.cluster_id) AS i FROM fends a JOIN fends b
  ON a.cluster_id <> b.cluster_id AND abs(a.ts - b.te) > 0 AND abs(a.ts - b.te) <= {DT}
  AND (a.xs - b.xe) ** 2 + (a.ys - b.ye) ** 2 <= 25""")
_item("greedy", """SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[]
  UNION ALL SELECT c.i,
    CASE WHEN list_contains(g.ts, c.target) OR list_contains(g.ss, c.source) THEN g.ts ELSE list_append(g.ts, c.target) END,
    CASE WHEN list_contains(g.ts, c.target) OR list_contains(g.ss, c.source) THEN g.ss ELSE list_append(g.ss, c.source) END
  FROM greedy g JOIN cands c ON c.i = g.i + 1""", "(i, ts, ss)")
_item("links", """SELECT unnest(ts) AS target, unnest(ss) AS source FROM (SELECT * FROM greedy ORDER BY i DESC LIMIT 1)""")
_item("climb", """SELECT source, target FROM links
  UNION ALL SELECT c.node, l.target FROM climb c JOIN links l ON l.source = c.root""", "(node, root)")

def _cand(ends: str, dt: str, dist2: str) -> str:
    return f"""SELECT a.cluster_id AS target, b.cluster_id AS source FROM {ends} a JOIN {ends} b
      ON a.cluster_id <> b.cluster_id AND abs(a.ts - b.te) > 0 AND abs(a.ts - b.te) <= {dt}
      AND (a.xs - b.xe) ** 2 + (a.ys - b.ye) ** 2 <= {dist2}"""


# --- detection: a run, repaired, filtered, repaired again
def _repair(x: str, src: str) -> None:
    """Items {x}roots (cluster_id, root) of the clusters that move and {x}clu, the events of ``src`` after the move."""
    _item(f"{x}span", f"SELECT cluster_id, min(t) AS ts, max(t) AS te FROM {src} GROUP BY cluster_id")
    _item(f"{x}ends", f"""SELECT cluster_id, ts, te, median(x) FILTER (t < ts + {DT}) AS xs, median(y) FILTER (t < ts + {DT}) AS ys,
        median(x) FILTER (t > te - {DT}) AS xe, median(y) FILTER (t > te - {DT}) AS ye
      FROM {src} JOIN {x}span USING (cluster_id) GROUP BY cluster_id, ts, te""")
    _item(f"{x}pairs", _cand(f"{x}ends", DT, "25"))
    _item(f"{x}cands", f"SELECT *, row_number() OVER (ORDER BY target, source) AS i FROM {x}pairs")
    _item(f"{x}greedy", _ITEMS["greedy"].split(" AS (", 1)[1][:-1].replace("greedy", f"{x}greedy").replace("cands", f"{x}cands"), "(i, ts, ss)")
    _item(f"{x}links", f"SELECT unnest(ts) AS target, unnest(ss) AS source FROM (SELECT * FROM {x}greedy ORDER BY i DESC LIMIT 1)")
    _item(f"{x}climb", f"""SELECT source, target FROM {x}links
      UNION SELECT c.node, l.target FROM {x}climb c JOIN {x}links l ON l.source = c.root""", "(node, root)")
    # a ring of clusters stays with its smallest member
    _item(f"{x}roots", f"""SELECT node AS cluster_id, coalesce(min(root) FILTER (root NOT IN (SELECT source FROM {x}links)), least(node, min(root))) AS root
      FROM {x}climb GROUP BY node""")
    _item(f"{x}clu", f"SELECT * REPLACE (coalesce(root, cluster_id) AS cluster_id) FROM {src} LEFT JOIN {x}roots USING (cluster_id)")


ONCE |= {f"{x}{n}" for x in ("pa_", "pb_") for n in ("pairs", "cands", "links", "roots", "clu")} | {"pfil"}
_repair("pa_", "pclu")
_item("pst", "SELECT coalesce(root, cluster_id) AS cluster_id, sum(n) AS steps FROM (SELECT cluster_id, count(DISTINCT k) AS n FROM pwc GROUP BY cluster_id) LEFT JOIN pa_roots USING (cluster_id) GROUP BY 1")
_item("pfil", """SELECT cluster_id, k, event_idx, x, y, t FROM pa_clu WHERE cluster_id IN (SELECT cluster_id FROM pst WHERE steps >= 3)
  AND cluster_id IN (SELECT cluster_id FROM pa_clu GROUP BY cluster_id HAVING count(*) >= 20)""")
_repair("pb_", "pfil")


def _again(prefix: str, base: str, names: list[str]) -> None:
    """Items once more over other clusters: ``names``, with the prefix before each name and `tr` replaced by ``base``."""
    for n in names:
        body = re.sub(r"\b(" + "|".join(names) + r")\b(?!\s*\.\s*\()", prefix + r"\1", _ITEMS[n])
        _ITEMS[f"{prefix}{n}"] = re.sub(r"\btr\b", base, body)
        if n in ONCE:
            ONCE.add(f"{prefix}{n}")


_item("ptr", "SELECT event_idx, cluster_id, x, y, t FROM pb_clu")
ONCE.add("ptr")
_again("p_", "ptr", ["num", "span", "init", "kal_s", "kal_k", "kal", "kgrid_l", "kgrid_g", "kgrid", "kpts", "ksm_1", "ksm", "trk",
                     "shape", "shp2", "meds", "mads", "zed", "clip", "qs", "qual", "checked"])

_ROUND_S = "round(px, 6) AS px, round(vx, 3) AS vx, round(ax, 1) AS ax, round(py, 6) AS py, round(vy, 3) AS vy, round(ay, 1) AS ay"
_ROUND_T = "round(x, 6) AS x, round(y, 6) AS y, round(u, 9) AS u, round(v, 9) AS v"
_LIFE = """SELECT cluster_id, count(t) AS n, (max(t) - min(t)) / 1000 AS ms FROM {src} GROUP BY cluster_id HAVING count(t) >= 2"""


def _hist(src: str) -> str:
    _item(f"dur_{src}", _LIFE.format(src=src))
    return f"""SELECT CAST(i AS INTEGER) AS bin, count(b) AS n FROM range(100) r(i) LEFT JOIN
      (SELECT least(99, floor((ms - lo) / ((hi - lo) / 100))) AS b
      FROM dur_{src}, (SELECT min(ms) AS lo, max(ms) AS hi FROM dur_{src})) ON b = i GROUP BY ALL"""


FINAL: dict[str, str] = {
    # sources
    "cast_float32": "SELECT event_idx, CAST(CAST(t + 16777216 AS FLOAT) AS DOUBLE) AS t FROM ev",
    "convert_time_limit": "SELECT event_idx, t FROM ev WHERE t <= (SELECT min(t) FROM ev) + 10000",
    "preview_stats": """SELECT 'x' AS "column", count(x) AS n, min(x)::DOUBLE AS lo, max(x)::DOUBLE AS hi FROM ev
        UNION ALL SELECT 'y', count(y), min(y), max(y) FROM ev UNION ALL SELECT 't', count(t), min(t), max(t) FROM ev
        UNION ALL SELECT 'p', count(p), min(p), max(p) FROM ev""",
    "event_summary": """SELECT count(*) AS n, min(t) AS t0, max(t) - min(t) AS duration, count(*) FILTER (p > 0) AS n_pos,
        count(*) FILTER (p <= 0) AS n_neg, max(x) + 1 AS width, max(y) + 1 AS height FROM ev""",
    # filters
    "filter_roi": "SELECT event_idx, x, y FROM ev WHERE x BETWEEN 100 AND 700 AND y BETWEEN 20 AND 90",
    "filter_time": "SELECT event_idx, t FROM ev WHERE t BETWEEN 4000 AND 20000",
    "filter_polarity": "SELECT event_idx, p FROM ev WHERE p > 0",
    "filter_combined": """SELECT count(*) FILTER (x BETWEEN 100 AND 700 AND y BETWEEN 20 AND 90
        AND t BETWEEN 4000 AND 20000 AND p > 0) AS kept, count(*) AS total FROM ev""",
    "tracks_in_window": f"""SELECT cluster_id, seq, t, {_ROUND_T} FROM trk WHERE t BETWEEN 6000 AND 12000
        AND cluster_id IN (SELECT cluster_id FROM trk WHERE t BETWEEN 6000 AND 12000 GROUP BY cluster_id HAVING count(*) >= 2)""",
    "mask_invalid_points": """SELECT cluster_id, seq, CASE WHEN ok THEN t END AS t, CASE WHEN ok THEN round(x, 6) END AS x,
        CASE WHEN ok THEN round(y, 6) END AS y FROM checked""",
    # slices
    "slice_closed": "SELECT event_idx, k FROM sl",
    "slice_overlap": "SELECT event_idx, k, is_overlap FROM so",
    "num_slices": "SELECT nn AS n FROM bnd",
    "display_window": f"SELECT event_idx, t FROM pos, bnd WHERE t > t0 + {DT} AND t <= t0 + 2 * {DT}",
    "nb_time_bins": f"SELECT cluster_id, seq, bin FROM nbp",
    "lightweight_median": "SELECT label AS cluster_id, k, xm, ym, tm FROM cen",
    "binned_mean": f"""SELECT f.cluster_id, f.seq, f.t, CASE WHEN ok THEN round(mx, 6) END AS mx, CASE WHEN ok THEN round(my, 6) END AS my
        FROM fitg f LEFT JOIN (SELECT g.cluster_id, g.seq, avg(m.x) AS mx, avg(m.y) AS my, max(m.t) > min(s.ts) AS ok
          FROM fitg g JOIN med m ON m.cluster_id = g.cluster_id AND m.t > g.t - 1000 AND m.t < g.t + 1000
          JOIN span s ON s.cluster_id = g.cluster_id GROUP BY g.cluster_id, g.seq) USING (cluster_id, seq)""",
    # pixels and regions
    "pseudo_frame": "SELECT k, x, y FROM px",
    "pixel_event_join": """SELECT s.k, label, event_idx FROM so s JOIN lab4 l ON l.k = s.k AND l.x = s.x AND l.y = s.y""",
    "dilate": """SELECT DISTINCT k, CAST(x + i AS INTEGER) AS x, CAST(y + j AS INTEGER) AS y FROM px,
        (SELECT unnest([-1, 0, 1]) AS i) a, (SELECT unnest([-1, 0, 1]) AS j) b
        WHERE x + i BETWEEN 0 AND 1279 AND y + j BETWEEN 0 AND 719""",
    "label_cc4": "SELECT k, x, y, label FROM lab4",
    "region_size_filter": """SELECT l.k, label, count(*) AS pixels, CAST(sum(n) AS BIGINT) AS events FROM lab4 l
        JOIN pxo o ON o.k = l.k AND o.x = l.x AND o.y = l.y GROUP BY l.k, label
        HAVING CASE WHEN l.k = 0 THEN count(*) ELSE sum(n) END >= 5""",
    "region_overlap": """SELECT a.k, a.label, count(DISTINCT b.label) AS n_prev FROM lab4 a JOIN lab4 b
        ON b.k = a.k - 1 AND b.x = a.x AND b.y = a.y GROUP BY a.k, a.label""",
    "region_overlap_dilated": """SELECT a.k, a.label, count(DISTINCT b.label) AS n_prev FROM lab4 a JOIN lab4 b
        ON b.k = a.k - 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY a.k, a.label""",
    "dbscan_core": "SELECT k, x, y, n, CAST(neighbours AS BIGINT) AS neighbours, core FROM core",
    "dbscan_labels": "SELECT k, x, y, n, label FROM dbscan",
    "disc_filter": "SELECT k, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, hits, round(hits / 29::DOUBLE, 9) AS v FROM disc",
    "otsu_threshold": "SELECT k, round(threshold, 9) AS threshold FROM otsu",
    "label_cc8": "SELECT k, x, y, label FROM lab8",
    "regionprops": "SELECT k, label, area, round(xm, 6) AS xm, round(ym, 6) AS ym FROM props",
    "pf_centroids": "SELECT k, label, area, round(xm, 6) AS xm, round(ym, 6) AS ym FROM props WHERE area > 5",
    # spatial joins
    "radius_join": """SELECT c.k, c.label, count(s.event_idx) AS events, count(s.event_idx) > 7 AS claimed
        FROM (SELECT k + 1 AS k, label, xm, ym FROM cen WHERE k + 1 < (SELECT nn FROM bnd)) c LEFT JOIN sl s
        ON s.k = c.k AND (s.x - xm) ** 2 + (s.y - ym) ** 2 <= 64 GROUP BY c.k, c.label""",
    "unclaimed_events": """SELECT event_idx, k FROM sl s WHERE NOT EXISTS (
        SELECT 1 FROM (SELECT c.k, c.xm, c.ym FROM (SELECT k + 1 AS k, label, xm, ym FROM cen) c JOIN sl s2
          ON s2.k = c.k AND (s2.x - xm) ** 2 + (s2.y - ym) ** 2 <= 64 GROUP BY c.k, c.label, c.xm, c.ym HAVING count(*) > 7) c
        WHERE c.k = s.k AND (s.x - xm) ** 2 + (s.y - ym) ** 2 <= 64)""",
    "nn_match": "SELECT k, label, coalesce(prev, -1) AS prev, coalesce(round(dist, 6), -1) AS dist FROM nnm",
    "correction_join": f"""SELECT f.cluster_id, f.seq, count(*) AS events, round(avg(e.x), 6) AS mx, round(avg(e.y), 6) AS my
        FROM fitg f JOIN tr e ON e.cluster_id = f.cluster_id AND e.t > f.t - 1000 AND e.t < f.t + 1000 GROUP BY ALL""",
    "repair_candidates": _cand("fends", DT, "25"),
    "repair_pf_candidates": _cand("fcends", f"1.5 * {DT}", "16"),
    "repair_tracks": """SELECT node AS cluster_id, root FROM climb WHERE root NOT IN (SELECT source FROM links)""",
    "neighbor_join": "SELECT cluster_id, seq, n_neighbors, round(w_sum, 6) AS w_sum FROM nbn",
    "track_cluster_map": "SELECT cluster_id, dense_rank() OVER (ORDER BY cluster_id) - 1 AS track FROM (SELECT DISTINCT cluster_id FROM trk)",
    # tracking of clusters
    "track_dbscan": "SELECT cluster_id, k, event_idx, x, y, t FROM clu",
    "test_mode": "SELECT cluster_id, k, event_idx, x, y, t FROM t_clu",
    "cluster_post_filter": "SELECT cluster_id, count(DISTINCT k) AS steps, count(*) AS events FROM clu1 GROUP BY cluster_id",
    "min_events_filter": "SELECT cluster_id, count(*) AS events FROM clu GROUP BY cluster_id HAVING count(*) >= 20",
    "residual_run": "SELECT cluster_id, k, event_idx, x, y, t FROM r_clu",
    "union_runs": """SELECT cluster_id, k, event_idx FROM clu1 UNION ALL SELECT cluster_id + 2305843009213693952, k, event_idx FROM r_clu
        WHERE cluster_id IN (SELECT cluster_id FROM r_clu GROUP BY cluster_id HAVING count(*) >= 20)""",
    "except_clustered": """SELECT DISTINCT event_idx FROM pos EXCEPT SELECT event_idx FROM sl s JOIN dbscan d
        ON d.k = s.k AND d.x = s.x AND d.y = s.y AND d.label >= 0""",
    "sort_events_by_time": "SELECT event_idx, t, row_number() OVER (ORDER BY t, event_idx) - 1 AS pos FROM ev",
    # trajectories
    "kalman_init": "SELECT cluster_id, round(x0, 6) AS x0, round(vx0, 4) AS vx0, round(y0, 6) AS y0, round(vy0, 4) AS vy0 FROM init",
    "kalman_init_pf": "SELECT cluster_id, round(x0, 6) AS x0, round(vx0, 4) AS vx0, round(y0, 6) AS y0, round(vy0, 4) AS vy0 FROM cinit",
    "kalman_filter": f"SELECT cluster_id, seq, t, {_ROUND_S} FROM kal",
    "kalman_resample": f"SELECT cluster_id, g, t, {_ROUND_S} FROM kgrid",
    "kalman_pf": f"SELECT cluster_id, g, t, round(px, 5) AS px, round(vx, 2) AS vx, round(ax, 0) AS ax, round(py, 5) AS py, round(vy, 2) AS vy, round(ay, 0) AS ay FROM cpf",
    "kalman_endpoints": f"""SELECT cluster_id, seq, t, {_ROUND_S} FROM kal WHERE seq = 1 OR (cluster_id, seq) IN
        (SELECT cluster_id, max(seq) FROM kal GROUP BY cluster_id)""",
    "smooth3x2": "SELECT cluster_id, seq, t, round(x, 6) AS x, round(y, 6) AS y, round(u, 3) AS u, round(v, 3) AS v FROM ksm",
    "track_single_cluster": f"""SELECT cluster_id, seq, t, {_ROUND_T} FROM trk WHERE cluster_id =
        (SELECT cluster_id FROM tr GROUP BY cluster_id ORDER BY count(*) DESC, cluster_id LIMIT 1)""",
    "median_per_t": "SELECT cluster_id, t, x, y FROM med",
    "hybrid_positions": "SELECT cluster_id, seq, t, round(x, 6) AS x, round(y, 6) AS y FROM ksm",
    "cell_moments": f"""SELECT cluster_id, CAST(g AS BIGINT) AS g, count(*) AS n, round(sum(tau), 6) AS s1, round(sum(tau ** 6), 6) AS s6,
        round(sum(x), 6) AS sx0, round(sum(x * tau ** 3), 5) AS sx3, round(sum(y * tau), 5) AS sy1, round(sum(x * x), 4) AS xx,
        round(sum(y * y), 4) AS yy FROM (SELECT *, floor(t / {DT}) AS g, t / {DT} - floor(t / {DT}) AS tau FROM med) GROUP BY cluster_id, g""",
    "offset_correction": "SELECT cluster_id, seq, t, round(x, 6) AS x, round(y, 6) AS y FROM corr",
    # validation
    "heading_variation": "SELECT cluster_id, round(angle, 6) AS angle FROM shape",
    "speed_variation": "SELECT cluster_id, round(velo, 6) AS velo FROM shape",
    "path_length": "SELECT cluster_id, round(path, 6) AS path FROM shape",
    "robust_z": "SELECT cluster_id, round(z_angle, 5) AS z_angle, round(z_velo, 5) AS z_velo, round(z_inv, 5) AS z_inv FROM zed",
    "quantile_norm": "SELECT cluster_id, round(q_angle, 5) AS q_angle, round(q_velo, 5) AS q_velo, round(q_inv, 5) AS q_inv FROM qual",
    "quality_score": "SELECT cluster_id, round(score, 5) AS score FROM qual",
    "quality_filter": "SELECT cluster_id, seq, t FROM checked WHERE ok",
    "detect_pixelwise": "SELECT cluster_id, k, event_idx, x, y, t FROM pb_clu",
    "validated_tracks": f"""SELECT t, {_ROUND_T}, dense_rank() OVER (ORDER BY cluster_id) - 1 AS trackid FROM p_checked WHERE ok""",
    "track_pixelwise": "SELECT cluster_id, k, event_idx, x, y, t FROM pclu",
    "weighted_median": "SELECT cluster_id, seq, round(med_u, 9) AS med_u, round(med_v, 9) AS med_v FROM nb WHERE n_neighbors >= 3",
    "weighted_mad": "SELECT cluster_id, seq, round(mad_u, 9) AS mad_u, round(mad_v, 9) AS mad_v FROM nb WHERE n_neighbors >= 3",
    "circular_medoid": "SELECT cluster_id, seq, round(med_angle, 6) AS med_angle, round(mad_angle, 6) AS mad_angle FROM nb WHERE n_neighbors >= 3",
    "neighborhood_filter": """SELECT cluster_id, seq, round(comp_dev, 4) AS comp_dev, round(dir_dev, 4) AS dir_dev,
        NOT (comp_dev > 3 OR dir_dev > 3) AS keep FROM nb""",
    "flag_track": "SELECT cluster_id, bool_or(ok) AS track_ok FROM checked GROUP BY cluster_id",
    "validation_stats": """SELECT count(*) FILTER (keep) AS kept_tracks, count(*) FILTER (NOT keep) AS removed_tracks,
        CAST(sum(bad) AS BIGINT) AS bad_points, CAST(sum(n) AS BIGINT) AS total_points FROM (
        SELECT bool_or(ok) AS keep, count(*) FILTER (NOT ok) AS bad, count(*) AS n FROM checked GROUP BY cluster_id)""",
    "segment_validity": """SELECT cluster_id, seq, ok AND nxt AS valid FROM (SELECT *, lead(ok) OVER (PARTITION BY cluster_id ORDER BY seq) AS nxt
        FROM checked) WHERE nxt IS NOT NULL""",
    "export_tracks": f"""SELECT t, {_ROUND_T}, dense_rank() OVER (ORDER BY cluster_id) - 1 AS trackid FROM checked WHERE ok""",
    # reports
    "detection_stats": """SELECT count(*) AS clusters, round(avg(n), 6) AS mean_events,
        round((SELECT count(DISTINCT event_idx) FROM used) / (SELECT count(*) FROM pos), 6) AS ratio
        FROM (SELECT cluster_id, count(DISTINCT event_idx) AS n FROM used GROUP BY cluster_id)""",
    "tracking_stats": """SELECT count(*) AS tracks, round(avg(d) / 1000, 6) AS mean_ms FROM
        (SELECT max(t) - min(t) AS d FROM trk GROUP BY cluster_id) WHERE d > 0""",
    "cluster_duration_hist": _hist("tr"),
    "track_duration_hist": _hist("trk"),
    "cluster_means_window": "SELECT cluster_id, round(avg(x), 6) AS xm, round(avg(y), 6) AS ym FROM tr WHERE t BETWEEN 4000 AND 8000 GROUP BY cluster_id",
    "centers_window": "SELECT label AS cluster_id, k, xm, ym, tm FROM cen WHERE tm BETWEEN 4000 AND 8000",
    "cluster_rank": """SELECT cluster_id, n, row_number() OVER (ORDER BY n DESC, cluster_id) AS rank
        FROM (SELECT cluster_id, count(*) AS n FROM tr GROUP BY cluster_id)""",
    "vmax_suggest": "SELECT round(2.5 * median(sqrt(u * u + v * v)), 9) AS vmax FROM trk",
    "speed_norm": """SELECT cluster_id, seq, round(sqrt(u * u + v * v) / (SELECT max(sqrt(u * u + v * v)) FROM trk), 6) AS a FROM trk""",
    "cluster_raster": "SELECT x, y, max(cluster_id) AS cluster_id FROM tr WHERE t BETWEEN 4000 AND 8000 GROUP BY x, y",
}
_interp("cgrid", "cser", ["x", "y"])
FINAL["interp_grid"] = "SELECT cluster_id, g, t, round(x, 6) AS x, round(y, 6) AS y FROM cgrid"


def _recordings() -> str:
    """The statement of one run, once for the particles of even and once for those of odd numbers."""
    all_events = "pos AS (SELECT * FROM ev WHERE p > 0)"
    one = _sql(_plain_zero(FINAL["validated_tracks"]))
    assert all_events in one
    runs = [f"""SELECT '{name}' AS stream_id, * FROM ({one.replace(all_events,
            f"pos AS (SELECT * REPLACE (x - {38 * odd} AS x) FROM ev WHERE p > 0 AND pid % 2 = {odd})")})"""
            for odd, name in ((0, "a"), (1, "b"))]
    return "\nUNION ALL\n".join(runs)


def _plain_zero(sql: str) -> str:
    """A term "+ 0" turns a rounded -0 into 0."""
    return re.sub(r"round\((.+?), (\d+)\)", r"(round(\1, \2) + 0)", sql)


def oracle_sql() -> dict[str, str]:
    return {**{k: _sql(_plain_zero(v)) for k, v in FINAL.items()}, "recordings_tracks": _recordings()}
