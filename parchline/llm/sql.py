"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_URLS = """
WITH cut AS (
    SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(rule, rule_host, rule_path, verdict) AS (
    VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
        ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), fits AS (
    SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
    FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""

_CHAT = """
WITH every AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), turns AS (
    SELECT *, role = 'assistant' AS loss,
        replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lb;') AS safe_role,
        replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lb;') AS safe_text
    FROM every
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN loss THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(string_agg(CASE WHEN loss THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
    CAST(sum(length(safe_role) + length(safe_text) + CASE WHEN loss THEN 3 + 5 + 6 + 4 ELSE 3 + 6 + 7 + 4 END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

_NEAR = """
WITH RECURSIVE lists AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM lists
), nodes AS (
    SELECT min(doc_id) AS node, any_value(s) AS s, md5(array_to_string(list_sort(s), chr(10))) AS k FROM sets WHERE len(s) > 0 GROUP BY k
), tokens AS (
    SELECT node, len(s) AS n, unnest(s) AS t FROM nodes
), links AS (
    SELECT a.node AS x, b.node AS y
    FROM tokens a JOIN tokens b ON a.t = b.t AND a.node < b.node AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
    GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), edges AS (
    SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(node, other) AS (
    SELECT node, node FROM nodes UNION SELECT r.node, e.y FROM reach r JOIN edges e ON e.x = r.other
), roots AS (
    SELECT node, min(other) AS root FROM reach GROUP BY node
), ids AS (
    SELECT k, root FROM nodes JOIN roots USING (node)
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id, doc_id = coalesce(root, doc_id) AS kept
FROM sets LEFT JOIN ids ON len(s) > 0 AND k = md5(array_to_string(list_sort(s), chr(10)))
"""

ORACLE_SQL: dict[str, str] = {"op2_url_filter": _URLS, "op3_chat_format": _CHAT, "op4_minhash_dedup": _NEAR}
