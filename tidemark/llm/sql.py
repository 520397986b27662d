"""DuckDB SQL for the operators that SQL can express, written from their definitions."""

from __future__ import annotations

from tidemark.llm import quality_rules as _q

_PHRASES = " + ".join(f"contains(lower(line), '{p}')::INT" for p in _q.BOILERPLATE)
_SEPARATORS = ", ".join(f"'{x}'" for x in _q.NAVIGATION)
_CLOSED = _q.CLOSED.replace("'", "''")

EXACT_DEDUP = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM t WINDOW same AS (PARTITION BY body)
"""

#: Base32 of a SHA-1: every five hex digits are four letters.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
same AS (SELECT body, min(page_id) AS first FROM p GROUP BY body)
SELECT page_id, strlen(body) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), 'string_agg', '')
    AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN same USING (body)
"""

QUALITY_RULES = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
tok AS (
  SELECT rid, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM docs),
win AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM tok)),
hit AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY rid),
ln AS (
  SELECT rid, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT rid, unnest(string_split(body, chr(10))) AS line FROM docs)),
judged AS (
  SELECT rid, line, list_sum(list_transform(w, lambda x: length(x))) AS n,
    (regexp_matches(right(rtrim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 8), '{_CLOSED}')
      OR len(w) >= {_q.LONG_LINE} AND len(regexp_extract_all(line, '{_q.SENTENCE}')) * {_q.LONG_LINE} >= len(w))
    AND NOT (len(list_filter(w, lambda x: x IN ({_SEPARATORS}))) * {_q.NAVIGATION_WORDS} > len(w))
    AND NOT (len(w) >= 2 AND line = upper(line) AND line <> lower(line))
    AND NOT (len(regexp_extract_all(line, '{_q.SYMBOLS}')) * 4 > len(w))
    AND NOT (len(w) >= 8 AND len(list_distinct(w)) * 2 < len(w))
    AND NOT (({_PHRASES}) * {_q.PHRASE_WORDS} > len(w)) AS good
  FROM ln WHERE len(w) > 0),
line_sums AS (
  SELECT rid, count(*) - count(DISTINCT line) AS dup, sum(n) AS chars, sum(n) FILTER (WHERE good) AS kept_chars
  FROM judged GROUP BY rid),
facts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(chars, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(body, '{_q.SYMBOLS}'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(kept_chars, 0)::BIGINT AS kept_chars
  FROM docs JOIN tok USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN line_sums USING (rid)),
verdict AS (
  SELECT *, n_words < {_q.MIN_WORDS} OR 100 * n_repeat_words > {_q.MAX_REPEAT_PCT} * n_words AS base_failed FROM facts)
SELECT *, NOT base_failed AND word_chars > 0 AND 1 - kept_chars / word_chars <= {_q.MAX_LOSS} AS kept FROM verdict
"""

LEXICAL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
asked AS (SELECT DISTINCT iid, item_id, unnest(w) AS term FROM i),
a AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY rid, term),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM tf, a GROUP BY term),
scored AS (
  SELECT iid, item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.w) * docs) // terms))))
    AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN d USING (rid), a GROUP BY iid, item_id, rid, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
