"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]"
WORDS = rf"list_filter(string_split_regex(t, '{SPACE}+'), lambda x: x <> '')"

EXACT_DEDUP = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS chars, sha256(regexp_replace(t, '{SPACE}', '', 'g')) AS text_sha256 FROM d),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, {WORDS} AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
pos AS (SELECT doc_id, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c, i
       FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM pos) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id),
f AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words,
             length(regexp_replace(t, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(covered.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN covered USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS failed FROM j
          WHERE source IS NOT NULL GROUP BY source),
mv AS (SELECT avg(failed / n) AS m, var_pop(failed / n) AS v FROM hosts),
prior AS (SELECT m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 0) ELSE 0 END AS k FROM mv),
bad AS (SELECT source FROM hosts, prior WHERE (failed + m * k) / (n + k) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
         AND coalesce(source NOT IN (SELECT source FROM bad), true) AS kept,
       coalesce(source IN (SELECT source FROM bad), false) AS host_rejected
FROM j
"""

MINHASH_DEDUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, {WORDS} AS ws FROM d),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:least(i + 4, len(ws))], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (s)
           WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
         WHERE 100 * common.n >= 75 * (x.n + y.n - common.n)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
          UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM comp LEFT JOIN sizes USING (doc_id)
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pos AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS gram
       FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d)),
gone AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY gram) AS least FROM pos)
         WHERE least < doc_id),
steps AS (SELECT *, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, true) AS new FROM gone),
runs AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM steps),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS after FROM spans),
total AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM spans GROUP BY doc_id),
front AS (SELECT doc_id, string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) AS h
          FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(front.h, '') || substr(d.h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN total USING (doc_id) LEFT JOIN front USING (doc_id)
"""

WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p JOIN f USING (payload_digest)
"""
