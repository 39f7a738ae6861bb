"""DuckDB statements for the corpus queries that SQL can express on whole tables."""
from __future__ import annotations

from ptrack.llm import licences, mixing
from ptrack.llm.clusters import CENTROIDS, DIM, ROUNDS, SCALE, SEED
from ptrack.llm.resampling import BUCKETS, LEAST_WORDS, PERCENT, SEED as SEED_13
from ptrack.llm.secrets import COMPLEMENTS, KINDS, PATTERNS, ROLE, SCOPE, STRONG
from ptrack.llm.shards import DIGITS, SHARDS

_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_COMPONENTS = """reach(node, root) AS (SELECT id, id FROM nodes
    UNION SELECT e.b, r.root FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON e.a = r.node),
  component AS (SELECT node AS id, min(root) AS component_id FROM reach GROUP BY node)"""


def vectors(cosine: float = 0.93) -> str:
    return f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e,
      sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
  nodes AS (SELECT id FROM v),
  links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.label = b.label AND a.id < b.id AND a.n > 0 AND b.n > 0
    WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= {cosine}),
  {_COMPONENTS}
  SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id OR b = id) AS n_links, component_id, id = component_id AS kept
  FROM component"""


def shingles(percent: int = 80, size: int = 5) -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=low)} AS w FROM documents),
  s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {size - 1}], ' ') AS s FROM w,
    LATERAL (SELECT unnest(range(1, greatest(len(w) - {size - 1}, least(len(w), 1)) + 1)) AS i) u),
  n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  nodes AS (SELECT doc_id AS id FROM documents),
  links AS MATERIALIZED (SELECT c.a, c.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y
      ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL) c JOIN n na ON na.doc_id = c.a JOIN n nb ON nb.doc_id = c.b
    WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
  {_COMPONENTS}
  SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id FROM component LEFT JOIN n ON doc_id = id"""


def secrets() -> str:
    quoted = {k: p.replace("'", "''") for k, p in PATTERNS.items()}
    valid = {"assign": f"length(regexp_extract(m, '{quoted['assign']}', 2)) >= 8", "access": "length(m) >= 16",
             "ident": f"length(regexp_extract(m, '{quoted['ident']}', 2)) >= 3",
             "random": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')"}
    found = " UNION ALL ".join(f"""SELECT id, {i} AS kind, '{ROLE[k]}' AS role, s, e FROM (
      SELECT *, sum(gap + length(m)) OVER (PARTITION BY id ORDER BY i) AS e, e - length(m) AS s FROM (
        SELECT id, i, m[i] AS m, length(g[i]) AS gap FROM (SELECT id, regexp_extract_all(text, '{quoted[k]}', 0) AS m,
          string_split_regex(text, '{quoted[k]}') AS g FROM d), LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i) u))
      WHERE {valid.get(k, 'true')}""" for i, k in enumerate(KINDS))
    needs = " OR ".join(f"(p.role = '{a}' AND q.role = '{b}')" for a, b in COMPLEMENTS)
    names = ", ".join(f"'{k}'" for k in KINDS)
    text = f"([{names}])[kind + 1] || ':' || s::BIGINT || ':' || e::BIGINT"
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(STRONG))
    return f"""WITH d AS MATERIALIZED (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents),
  p AS MATERIALIZED ({found}),
  kept AS (SELECT * FROM p WHERE kind < {len(STRONG)} OR EXISTS (SELECT 1 FROM p q WHERE q.id = p.id AND greatest(q.s, p.s) - least(q.e, p.e) <= {SCOPE} AND ({needs}))),
  per AS (SELECT id, {counts}, string_agg({text}, ',' ORDER BY s, kind, e) FILTER (kind < {len(STRONG)}) AS base,
    string_agg({text}, ',' ORDER BY s, kind, e) AS spans FROM kept GROUP BY id)
  SELECT d.id AS doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in STRONG)}, sha256(coalesce(base, '')) AS base_sha256,
    coalesce(spans, '') AS spans FROM d LEFT JOIN per ON per.id = d.id"""


def licence_scan() -> str:
    known = ", ".join(f"({i}, '{n}', '{t.replace(chr(39), chr(39) * 2)}')" for i, (n, t) in enumerate(licences.TEMPLATES))
    terms = "unnest(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''))"
    return f"""WITH f AS MATERIALIZED (SELECT doc_id, concat_ws('/', source, lang, floor(doc_id / 64)::BIGINT::VARCHAR, doc_id::VARCHAR || '.txt') AS path,
    coalesce(text, '') AS text FROM documents),
  h AS MATERIALIZED (SELECT doc_id, header FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS header FROM f)
    WHERE regexp_matches(header, '{licences.CUES}')),
  tf AS MATERIALIZED (SELECT header, term, count(*) AS tf FROM (SELECT header, {terms.format("header")} AS term FROM (SELECT DISTINCT header FROM h)) GROUP BY ALL),
  df AS MATERIALIZED (SELECT term, count(*) AS df FROM h JOIN tf USING (header) GROUP BY term),
  idf AS (SELECT term, coalesce(df, 0) AS df, ln(((SELECT count(*) FROM h) + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0 AS idf FROM df),
  a AS MATERIALIZED (SELECT header, term, tf * idf AS w FROM tf JOIN idf USING (term)),
  b AS MATERIALIZED (SELECT k, licence, term, n * coalesce(idf, ln((SELECT count(*) FROM h) + 1.0) + 1.0) AS v FROM (
    SELECT k, licence, term, count(*) AS n FROM (SELECT k, licence, {terms.format("t")} AS term FROM (VALUES {known}) x(k, licence, t)) GROUP BY ALL) LEFT JOIN idf USING (term)),
  cos AS MATERIALIZED (SELECT header, k, licence, round(sum(w * v) / (any_value(la) * any_value(lb)), 9) AS similarity FROM a JOIN b USING (term)
    JOIN (SELECT header, sqrt(sum(w * w)) AS la FROM a GROUP BY header) USING (header) JOIN (SELECT k, sqrt(sum(v * v)) AS lb FROM b GROUP BY k) USING (k) GROUP BY ALL),
  own AS MATERIALIZED (SELECT doc_id, licence, similarity FROM h JOIN cos USING (header) WHERE similarity >= {licences.LEAST}
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, licence) = 1),
  w AS (SELECT doc_id, sum(len(string_split_regex(header, '[\\x20\\x09-\\x0D]+'))) AS hw FROM h GROUP BY doc_id),
  whole AS MATERIALIZED (SELECT f.doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, licence, similarity,
    licence IS NOT NULL AND len({_WORDS.format(text="text")}) - coalesce(hw, 0) <= {licences.FILE_WORDS} AS is_file
    FROM f LEFT JOIN own ON own.doc_id = f.doc_id LEFT JOIN w ON w.doc_id = f.doc_id),
  held AS MATERIALIZED (SELECT dir AS up, licence AS held FROM whole WHERE is_file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, doc_id) = 1),
  near AS MATERIALIZED (SELECT dir, up, held FROM (SELECT DISTINCT dir FROM whole) JOIN held ON up = '' OR dir = up OR starts_with(dir, up || '/')
    QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(up) DESC) = 1)
  SELECT doc_id, path, coalesce(licence, held) AS licence, similarity,
    CASE WHEN licence IS NOT NULL THEN 'header' WHEN held IS NOT NULL THEN 'directory' END AS found_in,
    CASE WHEN licence IS NULL THEN up END AS holder FROM whole LEFT JOIN near USING (dir)"""


# crc32 as SQL: the table of 256 entries from the polynomial, then a fold over the bytes
_CRC_TABLE = """crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def _crc(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::UBIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT"""


def clusters(count: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT id, any_value(vec_id) AS vec_id, any_value(v.e) AS e, min(struct_pack(d := d, k := k)) AS best FROM (
          SELECT id, vec_id, v.e, k, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r} c) v GROUP BY id)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN (SELECT k, list(f ORDER BY i) AS e FROM (
              SELECT k, i, (s - ((s % n) + n) % n) // n AS f FROM (SELECT best.k AS k, i, sum(e[i]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, {dim + 1})) AS i) GROUP BY ALL))
              GROUP BY k) m ON m.k = c.k)""")
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dim}),
  c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR), e) - 1 AS k, e FROM v WHERE vec_id IS NOT NULL QUALIFY k < {count}),
  {", ".join(steps)}
  SELECT vec_id, best.k::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.k = a.best.k"""


def shards(count: int = SHARDS) -> str:
    bids = ", ".join(f"ln((('0x' || substr(md5('{i}:' || coalesce(doc_id::VARCHAR, '')), 1, {DIGITS}))::BIGINT::DOUBLE + 0.5) / {16 ** DIGITS}.0)" for i in range(count + 1))
    return f"""WITH {_CRC_TABLE},
  b AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, [{bids}] AS bids FROM documents),
  r AS MATERIALIZED (SELECT doc_id, (octet_length(encode(text)) + 1)::BIGINT AS size, {_crc("text")} AS text_crc32, 'key' AS law,
    (list_position(bids[1:{count}], list_max(bids[1:{count}])) - 1)::INTEGER AS shard, (list_position(bids, list_max(bids)) - 1)::INTEGER AS grown_shard FROM b, crc)
  SELECT doc_id, size, text_crc32, law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM r"""


def resampling(percent: int = PERCENT, least: int = LEAST_WORDS, buckets: int = BUCKETS, seed: str = SEED_13) -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH {_CRC_TABLE},
  d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {found} AS w FROM documents),
  dw AS MATERIALIZED (SELECT id, unnest(w) AS w FROM d), tw AS MATERIALIZED (SELECT unnest({found}) AS w FROM benchmark),
  h AS MATERIALIZED (SELECT w, {_crc("w")} % {buckets} AS b FROM (SELECT w FROM dw UNION SELECT w FROM tw), crc),
  own AS MATERIALIZED (SELECT b, count(*) AS n FROM dw JOIN h USING (w) GROUP BY b), aim AS MATERIALIZED (SELECT b, count(*) AS n FROM tw JOIN h USING (w) GROUP BY b),
  gain AS MATERIALIZED (SELECT own.b, floor(1000 * ln((coalesce(aim.n, 0)::DOUBLE + 1) * ((SELECT count(*) FROM dw)::DOUBLE + {buckets}) /
    ((own.n::DOUBLE + 1) * ((SELECT count(*) FROM tw)::DOUBLE + {buckets}))))::BIGINT AS g FROM own LEFT JOIN aim USING (b)),
  per AS (SELECT id, count(*) AS n, sum(g) AS s FROM dw JOIN h USING (w) JOIN gain USING (b) GROUP BY id),
  s AS MATERIALIZED (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce((s - ((s % n) + n) % n) // n, 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS noise FROM d LEFT JOIN per USING (id)),
  r AS (SELECT doc_id, n_features, weight, weight + noise AS score, n_features >= {least} AS able FROM s),
  k AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS n FROM r)
  SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= {percent} * n // 100 THEN place END AS rank FROM k"""


ORACLE = {"op11_centroid_clusters": clusters(), "op12_rendezvous_shards": shards(), "op13_importance_resampling": resampling(), "op1_vector_dedup": vectors(), "op3_mix_sources": mixing.oracle_sql(), "op6_licence_scan": licence_scan(), "op7_secret_scan": secrets(), "op8_shingle_join": shingles()}
