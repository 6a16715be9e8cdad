"""DuckDB SQL for the queries that SQL can express on whole tables."""

WARC = """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages
), f AS (
  SELECT digest, min(page_id) AS page FROM p WHERE n >= 100 GROUP BY digest
)
SELECT p.page_id, p.n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN f.page IS NOT NULL AND f.page <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.page <> p.page_id THEN f.page END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
"""

LINE_DEDUP = r"""
WITH raw AS (
  SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents
), lines AS (
  SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p
  FROM (SELECT doc_id, i, regexp_replace(line, '^\s+|\s+$', '', 'g') AS x FROM raw) WHERE x <> ''
), w AS (
  SELECT doc_id, p, x, lead(x, 1) OVER d AS y, lead(x, 2) OVER d AS z FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY p)
), placed AS (
  SELECT doc_id, p, first_value(doc_id) OVER o AS fd, first_value(p) OVER o AS fp
  FROM w WHERE z IS NOT NULL WINDOW o AS (PARTITION BY x, y, z ORDER BY doc_id, p)
), later AS (
  SELECT doc_id, CASE WHEN fd = doc_id THEN greatest(p, fp + 3) ELSE p END AS a, p + 2 AS b
  FROM placed WHERE NOT (fd = doc_id AND fp = p)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS p FROM later WHERE a <= b
), n AS (
  SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id
), g AS (
  SELECT doc_id, count(*) AS removed_lines FROM gone GROUP BY doc_id
), kept AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.i) AS text
  FROM raw r LEFT JOIN lines l ON r.doc_id = l.doc_id AND r.i = l.i LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.p = l.p
  WHERE gone.p IS NULL GROUP BY r.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(removed_lines, 0) AS BIGINT) AS removed_lines,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS text_sha256
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

TOKEN_COUNTS = rf"""
WITH c AS (
  SELECT source, lang, {_WORDS} AS words, len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')) AS runs FROM documents
), u AS (
  SELECT source, lang, 'words-1' AS tokenizer, words AS tokens FROM c WHERE words >= 50
  UNION ALL SELECT source, lang, 'runs-2', runs FROM c
)
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens FROM u GROUP BY ALL
"""

MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, CAST({_WORDS} AS BIGINT) AS size,
         -ln((CAST('0x' || md5('mix' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:13] AS BIGINT) + 0.5) / 4503599627370496.0)
         / (0.1 + 0.9 * length(regexp_replace(coalesce(text, ''), '[^\p{{L}}]+', '', 'g')) / greatest(length(coalesce(text, '')), 1)) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s
), f AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / w AS full_at FROM w
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY full_at, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY full_at, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f
), t AS (
  SELECT source, source_size, least(most, w * (SELECT arg_min(level, (full_at, k)) FROM l WHERE level <= full_at)) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(budget // greatest(source_size, 1) * size + greatest(0, least(size, budget - budget // greatest(source_size, 1) * source_size - earlier)) AS BIGINT) AS taken
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": WARC, "op6_line_dedup": LINE_DEDUP, "op7_token_counts": TOKEN_COUNTS, "op10_mixing": MIXING}
