"""DuckDB SQL of the queries that SQL can express over whole tables in reasonable time."""

from __future__ import annotations

from tallyspark.llm import fill_middle, hard_negatives, licenses

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_benchmark_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce({_WORDS}, []) AS words FROM documents),
b AS (SELECT item_id, words, least(13, len(words)) AS size FROM (SELECT item_id, coalesce({_WORDS}, []) AS words FROM benchmark) WHERE len(words) > 0),
bw AS (SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS i FROM b)),
dw AS (SELECT n, i, size, array_to_string(words[i:i + size - 1], ' ') AS k FROM (SELECT n, words, size, unnest(range(1, greatest(len(words) - size + 2, 1))) AS i FROM d, (SELECT DISTINCT size FROM bw))),
m AS (SELECT DISTINCT n, i, size, item_id FROM dw JOIN bw USING (size, k)),
h AS (SELECT n, count(DISTINCT p) AS hit FROM (SELECT n, unnest(range(i, i + size)) AS p FROM m) GROUP BY n),
t AS (SELECT n, count(DISTINCT item_id) AS items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM m GROUP BY n)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(hit, 0) AS n_hit, coalesce(items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(hit, 0) > 0 AND 20 * coalesce(hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN h USING (n) LEFT JOIN t USING (n)""",
    "op2_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS n, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT n, doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: md5(array_to_string(words[i:i + 4], ' ')))) WHEN len(words) > 0 THEN [md5(array_to_string(words, ' '))] ELSE [] END AS shingles FROM w),
e AS (SELECT n, len(shingles) AS size, unnest(shingles) AS k FROM s WHERE doc_id IS NOT NULL),
shared AS (SELECT k FROM e GROUP BY k HAVING count(*) > 1),
f AS (SELECT e.* FROM e JOIN shared USING (k)),
links AS (SELECT a.n AS x, b.n AS y FROM f a JOIN f b ON a.k = b.k AND a.n <> b.n GROUP BY a.n, b.n, a.size, b.size HAVING 100 * count(*) >= 75 * (a.size + b.size - count(*))),
reach AS (SELECT n AS u, n AS v FROM s UNION SELECT reach.u, links.y FROM reach JOIN links ON reach.v = links.x)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, min(o.doc_id) AS component_id FROM s JOIN reach ON s.n = u JOIN s AS o ON o.n = v GROUP BY s.n, s.doc_id, s.shingles""",
    "op3_license_scans": licenses.ORACLE_SQL,
    "op6_substring_dedup": r"""
WITH w AS (SELECT row_number() OVER () AS n, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT n, doc_id, unnest(list_transform(range(1, len(words) - 18), lambda i: md5(array_to_string(words[i:i + 19], ' ')))) AS k, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20),
late AS (SELECT n, i FROM (SELECT n, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT n, unnest(range(i, i + 20)) AS p FROM late),
runs AS (SELECT n, count(*) AS removed, count(*) FILTER (WHERE before IS DISTINCT FROM p - 1) AS spans FROM (SELECT n, p, lag(p) OVER (PARTITION BY n ORDER BY p) AS before FROM gone) GROUP BY n),
each AS (SELECT n, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
kept AS (SELECT n, string_agg(word, ' ' ORDER BY p) AS text FROM each ANTI JOIN gone USING (n, p) GROUP BY n)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256, coalesce(spans, 0) AS n_spans FROM w LEFT JOIN runs USING (n) LEFT JOIN kept USING (n)""",
    "op9_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, role AS r, text AS t, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
  (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, n, who, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(n, who)))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(15 + 2 * length(role || text) - length(regexp_replace(role || text, '[\\#<:\n]', '', 'g')))::BIGINT AS formatted_chars, 0 AS n_rewrites
FROM c GROUP BY conv_id""",
    "op12_fill_in_middle": fill_middle.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
