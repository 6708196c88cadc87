WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), occ AS (
    SELECT rid, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), post AS (
    SELECT rid, doc_id, term, count(*) AS tf FROM occ GROUP BY ALL
), len AS (
    SELECT rid, CAST(sum(tf) AS BIGINT) AS n FROM post GROUP BY rid
), whole AS (
    SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM len
), dfs AS (
    SELECT term, count(*) AS df FROM post GROUP BY term
), q AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
    SELECT q.item_id, p.rid, p.doc_id,
           CAST(sum(CAST(floor(1000 * ln((2 * w.big_n + 2) / (2 * f.df + 1))) AS BIGINT) * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (100 - 50 + (50 * l.n * w.big_n) // w.big_l)))) AS BIGINT) AS score
    FROM q JOIN post p USING (term) JOIN dfs f USING (term) JOIN len l USING (rid) CROSS JOIN whole w GROUP BY ALL
), ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50
