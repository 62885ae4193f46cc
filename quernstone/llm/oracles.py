"""DuckDB SQL for the queries of this subpackage that SQL can express at the size of the driver's tables.

The others need tokenizers, XXH64 or learned models, which SQL hasn't; tests
compare those with brute-force versions.
"""

from __future__ import annotations

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _rejected(rules: tuple[str, ...], limit: float) -> str:
    """Hosts whose rate of any rule, shrunk with the beta prior of quality.beta_prior, is over the limit."""
    parts = []
    for r in rules:
        parts.append(f"""SELECT source FROM (SELECT h.source, h.{r} AS f, h.n_docs AS n, p.* FROM hosts h, (
SELECT mean, CASE WHEN mean <= 0 OR mean >= 1 THEN NULL ELSE least(greatest(CASE WHEN var > within / 1e6 THEN within / var - 1 ELSE 1e6 END, 1e-3), 1e6) END AS strength FROM (
SELECT mean, within, CASE WHEN scale > 1e-12 THEN (r2 / n - mean * mean - within * lost) / scale ELSE 0 END AS var FROM (
SELECT n, r2, f / n AS mean, f / n * (1 - f / n) AS within, (k - 1) / n AS lost, 1 - n2 / (n * n) - (k - 1) / n AS scale FROM (
SELECT sum(n_docs)::DOUBLE AS n, sum({r})::DOUBLE AS f, sum(n_docs * ({r} / n_docs) * ({r} / n_docs)) AS r2, count(*)::DOUBLE AS k, sum(n_docs::DOUBLE * n_docs) AS n2 FROM hosts)))) p)
WHERE (f + coalesce(mean * strength, mean * 1e6 + 1e-6)) / (n + coalesce(strength, 1e6 + 2e-6)) > {limit}""")
    return "\nUNION ".join(parts)


_QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: trim(x, {_SPACES}) <> '') AS lines FROM d),
win AS (SELECT k, i, w[i:i + 2] AS key FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM (SELECT k, i, count(*) OVER (PARTITION BY k, key) AS c FROM win) WHERE c > 1) GROUP BY k),
m AS (SELECT d.doc_id, d.source, len(w.w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(w.lines) - len(list_distinct(w.lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
FROM d JOIN w USING (k) LEFT JOIN rep USING (k)),
hosts AS (SELECT source, count(*) AS n_docs, count(*) FILTER (n_words < 50) AS too_short, count(*) FILTER (100 * n_repeat_words > 50 * n_words) AS repetitive,
count(*) FILTER (100 * n_symbols > 10 * word_chars) AS symbols, count(*) FILTER (n_dup_lines > 10) AS dup_lines FROM m WHERE source IS NOT NULL GROUP BY source),
rejected AS ({_rejected(("too_short", "repetitive", "symbols", "dup_lines"), 0.5)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected, NOT base_failed AND NOT host_rejected AS kept FROM (
SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, source IS NOT NULL AND source IN (SELECT source FROM rejected) AS host_rejected FROM m)"""

_VECTORS = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT k, vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE len(e) > 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.k AS a, b.k AS b FROM u a JOIN u b ON a.k <> b.k AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach AS (SELECT k AS a, k AS b FROM u UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT r.a AS k, min(u.vec_id) AS component_id FROM reach r JOIN u ON u.k = r.b GROUP BY r.a), n AS (SELECT a AS k, count(*) AS n FROM links GROUP BY a),
e AS (SELECT row_number() OVER () AS k, vec_id FROM embeddings)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, e.vec_id IS NOT DISTINCT FROM coalesce(c.component_id, e.vec_id) AS kept
FROM e LEFT JOIN u ON u.vec_id = e.vec_id LEFT JOIN c ON c.k = u.k LEFT JOIN n ON n.k = u.k"""

_LINES = f"""WITH l AS (SELECT k, doc_id, unnest(s) AS line, unnest(range(len(s))) AS pos FROM (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
n AS (SELECT k, doc_id, line, pos, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, min(doc_id) AS first FROM n WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT n.*, often.first IS NOT NULL AND n.doc_id IS DISTINCT FROM often.first AS gone FROM n LEFT JOIN often USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY k, doc_id"""

_REPEATS = """WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT k, unnest(range(1, octet_length(b) - 198)) AS i, b FROM d WHERE octet_length(b) >= 200),
m AS MATERIALIZED (SELECT k, i, md5(b[i:i + 199]) AS m FROM s),
often AS (SELECT m FROM m GROUP BY m HAVING count(*) > 1),
hit AS (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS p FROM m SEMI JOIN often USING (m)),
run AS (SELECT k, i, count(*) FILTER (p IS NULL OR i > p + 200) OVER (PARTITION BY k ORDER BY i) AS r FROM hit),
span AS MATERIALIZED (SELECT k, min(i) AS a, max(i) + 200 AS z FROM run GROUP BY k, r),
piece AS (SELECT k, lag(z, 1, 1) OVER (PARTITION BY k ORDER BY a) AS a, a AS z FROM span UNION ALL SELECT k, max(z), NULL FROM span GROUP BY k),
t AS (SELECT k, unhex(string_agg(hex(b[a:coalesce(z - 1, octet_length(b))]), '' ORDER BY a)) AS t FROM (SELECT * FROM piece WHERE z IS NULL OR z > a) JOIN d USING (k) GROUP BY k),
n AS (SELECT k, count(*) AS n, sum(z - a) AS gone FROM span GROUP BY k)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(coalesce(t.t, d.b)) AS kept_sha256
FROM d LEFT JOIN n USING (k) LEFT JOIN t USING (k)"""

ORACLES: dict[str, str] = {"op1_quality_rules": _QUALITY, "op2_embedding_dedup": _VECTORS, "op5_suffix_dedup": _REPEATS, "op7_line_dedup": _LINES}
