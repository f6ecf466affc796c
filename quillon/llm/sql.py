"""DuckDB SQL for the queries that SQL can express."""

from quillon.llm import mixing as M
from quillon.llm import quality as Q
from quillon.llm import urls as U

W = r"'[^\x20\x09-\x0D]+'"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


QUALITY = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, {W}) AS ws FROM t),
g AS (SELECT r, i, ws[i:i+2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM g) WHERE k > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t),
ll AS (SELECT r, count(*) AS n, count(DISTINCT line) AS d FROM l WHERE regexp_matches(line, {W}) GROUP BY r),
m AS (SELECT w.r, doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(ll.n, 0)::BIGINT AS n_lines,
  coalesce(ll.n - ll.d, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON w.r = rep.r LEFT JOIN ll ON w.r = ll.r),
f AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PCT} * n_words AS base_failed,
  n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PCT} * n_words OR 100 * n_symbols > {Q.MAX_SYMBOL_PCT} * n_words OR 100 * n_dup_lines > {Q.MAX_DUP_LINE_PCT} * n_lines AS failed FROM m),
h AS (SELECT source, count(*) AS host_docs, count(*) FILTER (WHERE failed) AS host_failed FROM f GROUP BY source),
o AS (SELECT sum(host_failed)::DOUBLE / sum(host_docs) AS mean, sum(host_failed::DOUBLE * host_failed / host_docs) / sum(host_docs) AS q FROM h),
p AS (SELECT mean, CASE WHEN q - mean * mean <= 1e-12 OR mean * (1 - mean) <= 1e-12 THEN 1000.0::DOUBLE ELSE least(1000.0::DOUBLE, greatest(1.0::DOUBLE, mean * (1 - mean) / (q - mean * mean) - 1)) END AS strength FROM o),
s AS (SELECT source, host_docs, host_failed, strength, (host_failed + mean * strength) / (host_docs + strength) AS rate FROM h, p),
v AS (SELECT *, rate - {Q.DEVIATIONS} * sqrt(rate * (1 - rate) / (host_docs + strength + 1)) > {Q.MAX_HOST_RATE} AS rejected FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT rejected AND NOT coalesce(rate * evidence > 1 - rate, false) AS kept, host_docs, host_failed, round(rate, 6) AS host_rate, rejected AS host_rejected,
  round(rate * evidence / (rate * evidence + 1 - rate), 6) AS posterior
FROM (SELECT *, greatest(CASE WHEN n_words > 0 AND 100 * n_symbols > {Q.MAX_SYMBOL_PCT} * n_words THEN 100 * n_symbols / ({Q.MAX_SYMBOL_PCT} * n_words)::DOUBLE END,
    CASE WHEN n_lines > 0 AND 100 * n_dup_lines > {Q.MAX_DUP_LINE_PCT} * n_lines THEN 100 * n_dup_lines / ({Q.MAX_DUP_LINE_PCT} * n_lines)::DOUBLE END) AS evidence FROM f) AS f
JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

_HOSTS = ", ".join(f"({_text(v)}, {_text(h)}, {_text(p)}, {_text(h + p)})" for v, h, p in U.HOST_RULES)
_PATTERNS = ", ".join(f"({i}, {_text(n)}, {_text(v)}, {_text(x)})" for i, (n, v, x, _) in enumerate(U.PATTERN_RULES))
URLS = rf"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, url,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{U.UPPER}', '{U.LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
hr(verdict, h, p, rule) AS (VALUES {_HOSTS}), pr(k, pattern, verdict, regex) AS (VALUES {_PATTERNS}),
a AS (SELECT r, max({{'n': length(rule), 'rule': rule, 'verdict': verdict}}) AS best FROM u JOIN hr ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY r),
b AS (SELECT r, max({{'a': verdict = 'allow', 'k': -k, 'pattern': pattern, 'verdict': verdict}}) AS best FROM u JOIN pr ON regexp_matches(url, regex) GROUP BY r)
SELECT page_id, host, path, a.best.rule AS rule, coalesce(a.best.verdict, b.best.verdict, 'allow') AS verdict, b.best.pattern AS pattern
FROM u LEFT JOIN a ON u.r = a.r LEFT JOIN b ON u.r = b.r
"""

_WEIGHT = "[" + ", ".join(f"{float(w)}::DOUBLE" for w in M.WEIGHTS) + f"][(k % {len(M.WEIGHTS)} + 1)::INT]"
MIX = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(len(regexp_extract_all(text, {W})), 0)::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT >> {60 - M.BITS * M.LEVELS} AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
w AS (SELECT *, {_WEIGHT} AS weight, {float(M.MOST_REPEATS)}::DOUBLE * source_size AS stop FROM k),
x AS (SELECT *, stop / weight AS ratio, {M.SHARE}::DOUBLE * sum(source_size) OVER () AS budget, sum(weight) OVER () AS weights FROM w),
y AS (SELECT *, (budget - coalesce(sum(stop) OVER p, 0)) / (weights - coalesce(sum(weight) OVER p, 0)) AS level FROM x WINDOW p AS (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), 'inf'::DOUBLE) AS lev FROM y),
t AS (SELECT source, source_size, least(lev * weight, stop) AS target FROM z),
v AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats FROM t),
g AS (SELECT source, hash, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY hash) AS through FROM d GROUP BY source, hash),
c AS (SELECT v.*, max(CASE WHEN through <= target - repeats * source_size OR (through - size <= target - repeats * source_size AND through - (target - repeats * source_size) < target - repeats * source_size - (through - size)) THEN hash END) AS last
  FROM v LEFT JOIN g ON v.source IS NOT DISTINCT FROM g.source GROUP BY v.source, source_size, target, repeats)
SELECT doc_id, size, source_size, round(target, 3) AS target, (size * (repeats + CASE WHEN hash <= last THEN 1 ELSE 0 END))::BIGINT AS taken, d.source
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""

TOPK = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.r <> c.r),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM k WHERE rank <= 5
"""

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
LEXICAL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{U.UPPER}', '{U.LOWER}'), {_TERM}) AS ts FROM documents WHERE text IS NOT NULL),
i AS (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct(regexp_extract_all(translate(text, '{U.UPPER}', '{U.LOWER}'), {_TERM}))) AS term FROM benchmark WHERE text IS NOT NULL),
n AS (SELECT count(*) AS docs, sum(len(ts))::BIGINT AS terms FROM d WHERE len(ts) > 0),
m AS (SELECT r, doc_id, 50 + (50 * len(ts) * docs) // terms AS m FROM d, n WHERE len(ts) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, n GROUP BY term),
s AS (SELECT q, any_value(item_id) AS item_id, m.r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN p USING (term) JOIN m ON p.r = m.r GROUP BY q, m.r),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 50
"""
