"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = rf"""
WITH items AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS win, least(8, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM windows),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
spot AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lens)),
hits AS (SELECT doc_id, item_id, n, i FROM spot JOIN windows USING (n, win)),
cover AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM docs LEFT JOIN cover USING (doc_id) LEFT JOIN who USING (doc_id)
"""

OP9 = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN (SELECT h, min(doc_id) AS least FROM win GROUP BY h) USING (h) WHERE least < doc_id),
removed AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(js, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM docs LEFT JOIN removed USING (doc_id)
"""

# The pages of the tables hold their text in one article element without anything else in it, and two kinds of references.
OP3 = r"""
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_extract(regexp_replace(coalesce(html, ''), '(?s)</article>.*', ''), '(?s)<article>(.*)', 1),
    '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text
  FROM pages)
"""

SQL = {"op3_html_extraction": OP3, "op1_decontamination": OP1, "op9_substrings": OP9}
