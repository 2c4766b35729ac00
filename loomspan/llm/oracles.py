"""DuckDB SQL of the operators that SQL expresses; each covers its whole table."""

from __future__ import annotations

from .quality_rules import QualityRules

_SP = r"[\x20\x09-\x0D]"


def _quality_rules_sql(rules: QualityRules = QualityRules()) -> str:
    lists = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in rules.common_words.items())
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT r, doc_id, lang, regexp_extract_all(text, '{word}') AS words, regexp_replace(text, '{_SP}+', '', 'g') AS tight,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    CASE lang {lists} ELSE {rules.all_words!r} END AS list
  FROM d),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM t),
g AS (SELECT r, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g WHERE gram IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
c AS (SELECT t.r, x.word AS word, count(*) AS n FROM t JOIN (
    SELECT r, lower(regexp_replace(word, '[.,;:!?]+$', '')) AS word FROM w) x ON x.r = t.r AND list_contains(t.list, x.word) GROUP BY 1, 2),
m AS (
  SELECT t.r, doc_id, lang, len(words) AS n_words, length(tight) AS word_chars, regexp_replace(tight, '\p{{L}}+', '', 'g') AS marks, tight,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM t LEFT JOIN rep ON rep.r = t.r),
s AS (
  SELECT r, doc_id, lang, n_words, word_chars, n_dup_lines, n_repeat_words,
    length(regexp_replace(tight, '\P{{Ll}}+', '', 'g')) AS c0, length(regexp_replace(tight, '\P{{Lu}}+', '', 'g')) AS c1,
    length(regexp_replace(marks, '[^0-9]+', '', 'g')) AS c2, length(regexp_replace(marks, '[^.,;:!?''()"-]+', '', 'g')) AS c3,
    length(regexp_replace(marks, '[^#*$%&|<>]+', '', 'g')) AS c4,
    n_words < {rules.min_base_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed
  FROM m),
h AS (
  SELECT r, lang, base_failed, n_words, 'c' AS hist, b.k AS bin, b.n::DOUBLE AS n FROM s,
    LATERAL (VALUES ('0', c0), ('1', c1), ('2', c2), ('3', c3), ('4', c4), ('5', word_chars - c0 - c1 - c2 - c3 - c4)) AS b(k, n)
  UNION ALL SELECT s.r, s.lang, s.base_failed, s.n_words, 'w', 'w' || c.word, c.n FROM s JOIN c ON c.r = s.r
  UNION ALL SELECT s.r, s.lang, s.base_failed, s.n_words, 'w', 'o', s.n_words - coalesce((SELECT sum(n) FROM c WHERE c.r = s.r), 0) FROM s),
ref AS (SELECT lang, hist, bin, sum(n) AS n FROM h WHERE NOT base_failed GROUP BY ALL),
tot AS (SELECT lang, hist, sum(n) AS nb FROM ref GROUP BY ALL),
own AS (SELECT r, hist, sum(n) AS na FROM h GROUP BY ALL),
refw AS (SELECT lang, sum(n_words) AS n FROM s WHERE NOT base_failed GROUP BY lang),
pairs AS (
  SELECT o.r, o.hist, q.bin, q.n / t.nb AS q, coalesce(h.n, 0) / o.na AS p
  FROM own o JOIN s ON s.r = o.r JOIN tot t ON t.lang IS NOT DISTINCT FROM s.lang AND t.hist = o.hist AND t.nb > 0
  JOIN ref q ON q.lang IS NOT DISTINCT FROM s.lang AND q.hist = o.hist LEFT JOIN h ON h.r = o.r AND h.hist = o.hist AND h.bin = q.bin
  WHERE o.na > 0
  UNION ALL
  SELECT h.r, h.hist, h.bin, 0, h.n / o.na FROM h JOIN own o ON o.r = h.r AND o.hist = h.hist AND o.na > 0
  JOIN tot t ON t.lang IS NOT DISTINCT FROM h.lang AND t.hist = h.hist AND t.nb > 0
  WHERE NOT EXISTS (SELECT 1 FROM ref q WHERE q.lang IS NOT DISTINCT FROM h.lang AND q.hist = h.hist AND q.bin = h.bin)),
js AS (
  SELECT r, hist, sqrt(greatest(0, sum(CASE WHEN p = 0 THEN 0.5 * q WHEN q = 0 THEN 0.5 * p
    ELSE 0.5 * p * log2(2 * p / (p + q)) + 0.5 * q * log2(2 * q / (p + q)) END))) AS d FROM pairs GROUP BY ALL),
j AS (SELECT r, max(d) FILTER (hist = 'c') AS dc, max(d) FILTER (hist = 'w') AS dw FROM js GROUP BY r)
SELECT s.doc_id, s.n_words::BIGINT AS n_words, s.word_chars::BIGINT AS word_chars, s.c4::BIGINT AS n_symbols, s.n_dup_lines::BIGINT AS n_dup_lines,
  s.n_repeat_words::BIGINT AS n_repeat_words, s.base_failed,
  NOT s.base_failed AND (s.n_words < {rules.min_words} OR coalesce(refw.n, 0) < {rules.min_reference_words}
    OR (coalesce(j.dc, 0) <= {rules.max_class_distance} + {rules.length_slack} / sqrt(greatest(s.n_words, 1))
      AND coalesce(j.dw, 0) <= {rules.max_word_distance} + {rules.length_slack} / sqrt(greatest(s.n_words, 1)))) AS kept
FROM s LEFT JOIN j ON j.r = s.r LEFT JOIN refw ON refw.lang IS NOT DISTINCT FROM s.lang
"""


_TOPK_SQL = """
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: q.v[i] * x.v[i]))::BIGINT AS score
  FROM x q JOIN x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id AND len(q.v) = len(x.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_WARC_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to, true AS verified
FROM f
"""

_LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

ORACLES: dict[str, str] = {
    "op2_quality_rules": _quality_rules_sql(),
    "op3_exact_topk": _TOPK_SQL,
    "op5_warc": _WARC_SQL,
    "op9_line_dedup": _LINES_SQL,
}
