"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, n, w[i:i + n - 1] AS g FROM (
    SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT rid, n, i, w[i:i + n - 1] AS g FROM (
    SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT rid, dw.n, i, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
owners AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN owners USING (rid)
"""

OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
f AS (
  SELECT rid, doc_id, source, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
dup AS (
  SELECT rid, i FROM (SELECT rid, i, w[i:i + 7] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM f WHERE len(w) > 7))
  QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (
  SELECT rid, CAST(sum(least(8, coalesce(nx - i, 8))) AS BIGINT) AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM dup) GROUP BY rid),
fig AS (
  SELECT rid, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_stutter
  FROM f LEFT JOIN rep USING (rid)),
j AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN n_words > 0 AND n_symbols > 0.1 * n_words THEN 2 ELSE 0 END
    + CASE WHEN n_words > 0 AND n_stutter > 0.3 * n_words THEN 2 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 12 * n_words) THEN 1 ELSE 0 END
    + CASE WHEN (n_lines > 1 AND n_dup_lines > 0.3 * n_lines) OR 10 * n_repeat_words > n_words THEN 1 ELSE 0 END AS failed_weight
  FROM fig),
h AS (
  SELECT source AS host, count(*) AS n, sum(CASE WHEN failed_weight > 0 OR base_failed THEN 1 ELSE 0 END) AS k FROM j GROUP BY source),
m AS (
  SELECT sum(k) / sum(n) AS mean, avg((k / n) * (k / n)) - avg(k / n) * avg(k / n) AS var, avg(1.0 / n) AS small FROM h),
pr AS (
  SELECT mean, CASE WHEN var - mean * (1 - mean) * small > 1e-12
    THEN greatest(mean * (1 - mean) / (var - mean * (1 - mean) * small) - 1, 1.0) ELSE 1e12 END AS weight FROM m),
v AS (SELECT host, (k + mean * weight) / (n + weight) > 0.3 AS strict FROM h, pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_weight,
       NOT base_failed AND failed_weight < CASE WHEN strict THEN 1 ELSE 2 END AS kept
FROM j JOIN v ON j.source IS NOT DISTINCT FROM v.host
"""

_TERMS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'),"
    r" '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
item AS (SELECT row_number() OVER () AS iid, item_id, unnest(list_distinct({_TERMS})) AS t FROM benchmark),
p AS (
  SELECT rid, doc_id, CAST(n AS BIGINT) AS n, t, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS t FROM d)
  WHERE t IN (SELECT t FROM item) GROUP BY rid, doc_id, n, t),
df AS (SELECT t, count(*) AS df FROM p GROUP BY t),
v AS (
  SELECT rid, doc_id, t, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))) AS x
  FROM p JOIN df USING (t), s),
r AS (SELECT iid, item_id, rid, doc_id, CAST(sum(x) AS BIGINT) AS score FROM item JOIN v USING (t) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 50
"""

ORACLE_SQL = {"op4_decontaminate": OP4, "op7_host_rules": OP7, "op13_ranked_search": OP13}
