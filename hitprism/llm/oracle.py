"""Queries that SQL can express, as SQL for DuckDB over the same tables."""

from hitprism.llm import quality
from hitprism.llm.queries import URL_RULES

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

URL_FILTERS = f"""
WITH after AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS a FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(a, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path FROM after
), rules(rule_host, rule_path, verdict) AS (VALUES {_RULES}),
best AS (
  SELECT DISTINCT ON (host, path) host, path, rule_host || rule_path AS rule, verdict
  FROM (SELECT DISTINCT host, path FROM parsed)
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  ORDER BY host, path, length(rule_host) + length(rule_path) DESC, length(rule_host) DESC
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parsed LEFT JOIN best USING (host, path)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
doc_windows AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM docs, (SELECT DISTINCT size FROM item_windows) WHERE len(w) >= size)
), hits AS (SELECT doc_id, i, size, item FROM doc_windows JOIN item_windows USING (size, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""

SUBSTRINGS = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)
), later AS (
  SELECT doc_id, i FROM windows JOIN (SELECT win, min(doc_id) AS first FROM windows GROUP BY win HAVING min(doc_id) < max(doc_id)) USING (win)
  WHERE first < doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM later),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

LINES = r"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(l[i : i + 2], chr(10)) AS win
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM docs WHERE len(l) >= 3)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, win, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM windows)
  WHERE n > 1 AND regexp_matches(win, '[^\x20\x09-\x0D]')
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS p FROM later),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS p FROM docs) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l), 0) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS text_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

_UNNESTED = (f"unnest([{', '.join(repr(r) for r in quality.RULES)}]) AS rule, "
             f"unnest([{', '.join(quality.RULES.values())}]) AS failed")
_WINDOW = " || ' ' || ".join(f"lead(word, {k}) OVER o" for k in range(quality.WINDOW))
_BASE = " OR ".join(f"({quality.RULES[r]})" for r in quality.BASE_RULES)

_SPACED = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents
), spelled AS (
  SELECT r, i, {_WINDOW} AS win FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs)
  WINDOW o AS (PARTITION BY r ORDER BY i)
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM spelled WHERE win IS NOT NULL
), repeats AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {quality.WINDOW})) AS p FROM windows WHERE n > 1) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '{_SPACED}') GROUP BY r
), measured AS (
  SELECT r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(lines.n, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
  FROM docs LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)
), shares AS (
  SELECT source, rule, count(*) AS n, sum(CAST(failed AS INT)) AS f
  FROM (SELECT source, {_UNNESTED} FROM measured WHERE source IS NOT NULL) GROUP BY source, rule
), moments AS (
  SELECT rule, least(greatest(avg(f / n), 1e-4::DOUBLE), 1 - 1e-4::DOUBLE) AS m, var_pop(f / n) AS v, avg(1 / n) AS inverse_n FROM shares GROUP BY rule
), true_variance AS (
  SELECT rule, m, greatest(v - m * (1 - m) * inverse_n, 1e-6::DOUBLE) AS v FROM moments
), priors AS (
  SELECT rule, m, least(greatest((m * (1 - m) - v) / v, 1.0::DOUBLE), 1e4::DOUBLE) AS weight FROM true_variance
), rejected AS (
  SELECT DISTINCT source FROM shares JOIN priors USING (rule) WHERE (f + m * weight) / (n + weight) > {quality.MAX_HOST_RATE}
), judged AS (
  SELECT *, {_BASE} AS base_failed, source IS NOT NULL AND source IN (SELECT source FROM rejected) AS host_rejected FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected,
  NOT base_failed AND NOT host_rejected AS kept
FROM judged
"""


def oracle_sql():
    return {
        "op1_url_filters": URL_FILTERS,
        "op3_benchmark_decontamination": DECONTAMINATION,
        "op5_quality_rules": QUALITY,
        "op7_substring_dedup": SUBSTRINGS,
        "op9_line_dedup": LINES,
    }
