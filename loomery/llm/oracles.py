"""DuckDB SQL for the queries that SQL can express on whole tables.

The others (unigram segmentation, a fitted model, packing, similarity classes, byte ranges, page trees, token files and
alignments) are compared with brute force in the tests.
"""

from __future__ import annotations

# words are runs of characters other than space and \x09-\x0D; DuckDB lists count from 1
_SPACE = r"[ \t\n\x0B\f\r]+"
_LINES = rf"""
ln AS (
  SELECT doc_id, source, i, line, regexp_replace(line, '{_SPACE}', '', 'g') AS chars,
         trim(regexp_replace(lower(line), '{_SPACE}', ' ', 'g')) AS norm
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM d)
  WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]'))"""

OP7 = rf"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, '') AS source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w
  FROM documents),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY 1),
{_LINES},
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY 1),
same AS (SELECT doc_id, md5(string_agg(norm, chr(10) ORDER BY i)) AS doc FROM ln GROUP BY 1),
hosts AS (SELECT source, count(DISTINCT coalesce(doc, '')) AS docs FROM d LEFT JOIN same USING (doc_id) GROUP BY 1),
common AS (SELECT source, norm FROM ln JOIN same USING (doc_id) JOIN hosts USING (source)
           GROUP BY source, norm, docs HAVING count(DISTINCT doc) > 50 AND count(DISTINCT doc) > 0.05 * docs),
gone AS (SELECT doc_id, sum(len(chars)) AS n FROM ln JOIN common USING (source, norm) GROUP BY 1),
base AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, len(regexp_replace(text, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
         (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         coalesce(gone.n, 0)::BIGINT AS line_chars_removed
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars - line_chars_removed >= 0.5 * word_chars AS kept
FROM base
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
{_LINES},
win AS (SELECT doc_id, norm AS a, i AS i1, lead(norm) OVER o AS b, lead(i) OVER o AS i2, lead(norm, 2) OVER o AS c, lead(i, 2) OVER o AS i3
        FROM ln WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i1) AS k FROM win WHERE c IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest([i1, i2, i3]) AS i FROM ranked WHERE k > 1),
parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM d),
made AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone.i IS NOT NULL) AS n_removed,
                coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone.i IS NULL), '') AS text
         FROM parts LEFT JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, n_lines, n_removed, n_removed > 0 AND NOT regexp_matches(text, '[^ \t\n\x0B\f\r]') AS emptied, md5(text) AS text_md5 FROM made
"""

SQL: dict[str, str] = {"op7_quality_rules": OP7, "op10_line_dedup": OP10}
