"""DuckDB SQL for the operators that SQL can express."""

from .licenses import GRAM, NOTICES, PHRASES, SHARE, SHORT

_WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, {_LOWER.format(f"trim(ls[i], {_WS})")} AS key
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
k AS (SELECT key, max(doc_id) AS keep FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id <> k.keep AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP5 = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""

OP10 = """
WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1, 's') AS path FROM u),
f AS (SELECT page_id, r.host || r.path AS rule, r.verdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC) AS rn
      FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM p LEFT JOIN f ON f.page_id = p.page_id AND f.rn = 1
"""



def _clustering(k: int = 40, rounds: int = 5, scale: int = 256, dims: int = 64) -> str:
    """Lloyd's rounds in long form, every vector against every centroid."""
    near = """n{r} AS MATERIALIZED (SELECT vec_id, c, d FROM (
  SELECT v.vec_id, m.c, sum((v.x - m.x) * (v.x - m.x)) AS d, row_number() OVER (PARTITION BY v.vec_id ORDER BY sum((v.x - m.x) * (v.x - m.x)), m.c) AS place
  FROM v JOIN c{r} m USING (i) GROUP BY v.vec_id, m.c) WHERE place = 1)"""
    step = """s{r} AS (SELECT n.c, v.i, sum(v.x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM n{r} n JOIN v USING (vec_id) GROUP BY n.c, v.i),
c{q} AS MATERIALIZED (SELECT m.c, m.i, CASE WHEN s.n IS NULL THEN m.x ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS x
  FROM c{r} m LEFT JOIN s{r} s ON s.c = m.c AND s.i = m.i)"""
    parts = [f"""WITH e AS (SELECT vec_id, embedding AS a FROM embeddings WHERE len(embedding) = {dims}
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
v AS MATERIALIZED (SELECT vec_id, unnest(range({dims})) AS i, floor({scale} * unnest(a)::DOUBLE)::HUGEINT AS x FROM e),
f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM e),
c0 AS MATERIALIZED (SELECT f.c, v.i, v.x FROM f JOIN v USING (vec_id) WHERE f.c < {k})"""]
    for r in range(rounds):
        parts += [near.format(r=r), step.format(r=r, q=r + 1)]
    parts.append(near.format(r=rounds))
    parts.append(f"h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)")
    return ",\n".join(parts) + f"""
SELECT n.vec_id, n.c::INTEGER AS cluster, n.d::BIGINT AS distance, (sum(n.d) OVER (PARTITION BY n.c))::BIGINT AS cluster_inertia,
       (sum(n.d) OVER ())::BIGINT AS inertia, h.h AS centroid_sha256
FROM n{rounds} n JOIN h USING (c)"""


def _licenses() -> str:
    """The spans by their definition, on word strings instead of hashes."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({text(label)}, {text(t)}, {base})" for own, base in ((PHRASES, "true"), (NOTICES, "false")) for label, t in own)
    words = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    gram = "array_to_string(ws[p + 1:p + {k}], ' ')"
    sizes = [k for k in range(1, GRAM + 1) if any(min(GRAM, len(t.split())) == k for _, t in PHRASES + NOTICES)]
    grams = " UNION ALL ".join(f"SELECT doc_id, p, {k} AS k, {gram.format(k=k)} AS gram FROM tok WHERE p + {k} <= len(ws)" for k in sizes)
    return f"""WITH raw(label, t, base) AS (VALUES {values}),
w AS (SELECT label, base, {words.format("t")} AS ws FROM raw),
t AS (SELECT row_number() OVER () AS id, label, base, ws, len(ws) AS n, least(len(ws), {GRAM}) AS k, len(ws) < {SHORT} AS short FROM w),
tt AS (SELECT *, CASE WHEN short THEN 0 ELSE n // {SHORT} END AS slack, CASE WHEN short THEN n ELSE ceil(n * {SHARE}) END AS need,
              CASE WHEN short THEN n - k + 1 ELSE ceil((n - k + 1) / 4) END AS least FROM t),
tg AS (SELECT id, k, q, array_to_string(ws[q + 1:q + k], ' ') AS gram FROM (SELECT id, k, n, ws, unnest(range(n)) AS q FROM tt) WHERE q + k <= n),
d AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS ws FROM documents),
tok AS (SELECT doc_id, ws, unnest(range(len(ws))) AS p FROM d),
g AS ({grams}),
hits AS (SELECT g.doc_id, tg.id, g.p - tg.q AS diagonal, count(*) AS votes FROM g JOIN tg USING (k, gram) GROUP BY ALL),
cut AS (SELECT h.*, tt.least, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, id ORDER BY diagonal) <= tt.slack THEN 0 ELSE 1 END AS apart
        FROM hits h JOIN tt USING (id)),
runs AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, id ORDER BY diagonal) AS span FROM cut),
fit AS (SELECT doc_id, id, span, diagonal FROM runs QUALIFY sum(votes) OVER (PARTITION BY doc_id, id, span) >= least),
tw AS (SELECT id, unnest(range(n)) AS q, unnest(ws) AS word FROM tt),
agree AS (SELECT f.doc_id, f.id, f.span, tw.q, min(f.diagonal + tw.q) AS place FROM fit f JOIN tw USING (id) JOIN d ON d.doc_id = f.doc_id
          WHERE f.diagonal + tw.q >= 0 AND d.ws[f.diagonal + tw.q + 1] = tw.word GROUP BY ALL),
spans AS (SELECT doc_id, id, label, base, n, count(*) AS agree, min(place) AS first FROM agree JOIN tt USING (id)
          GROUP BY doc_id, id, span, label, base, n, need HAVING count(*) >= need),
per AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
               array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels,
               array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(agree / n) AS score FROM spans GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN per USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": OP4,
    "op5_exact_dedup": OP5,
    "op10_url_filter": OP10,
    "op11_clustering": _clustering(),
    "op13_licenses": _licenses(),
}
