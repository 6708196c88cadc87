WITH t AS (
    SELECT conv_id AS c, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS u,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT c, list(u ORDER BY pos) AS us,
           xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT),
               lambda a, b: list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda p, q: xor(p >> 1, (p & 1) * 3988292384))), 4294967295) % 9 AS h
    FROM t GROUP BY c
), whole AS (
    SELECT o.c, list_concat(coalesce(b.us[1 : o.h], []), o.us[o.h + 1 :]) AS us FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 5
), path AS (
    SELECT c, len(us) AS n, unnest(range(len(us) + 1)) AS depth, us FROM whole
), named AS (
    SELECT c, n, depth, min(c) OVER (PARTITION BY depth, us[1 : depth]) AS node, CASE WHEN depth > 0 THEN strlen(us[depth].x) ELSE 0 END AS bytes FROM path
), nodes AS (
    SELECT node, depth, count(*) AS n_convs, max(n) = depth AS leaf, (count(*) - 1) * max(bytes) AS saved,
           sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256
    FROM named GROUP BY node, depth
), linked AS (
    SELECT x.*, p.node AS parent FROM nodes x LEFT JOIN named p ON p.c = x.node AND p.depth = x.depth - 1
), below AS (
    SELECT p.node, p.depth, count(*) FILTER (x.leaf) AS n_leaves, CAST(sum(x.saved) AS BIGINT) AS saved_tokens
    FROM nodes x JOIN named p ON p.c = x.node AND p.depth <= x.depth GROUP BY p.node, p.depth
), kids AS (
    SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY 1, 2
)
SELECT node AS conv_id, depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
FROM linked JOIN below USING (node, depth) LEFT JOIN kids USING (node, depth)
