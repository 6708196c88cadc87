WITH w AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), lines AS (
    SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1
), win AS (
    SELECT rid, i, array_to_string(words[i : i + 4], ' ') AS s FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w)
), again AS (
    SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM (SELECT *, count(*) OVER (PARTITION BY rid, s) AS n FROM win) WHERE n > 1
), cover AS (
    SELECT rid, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n_repeat_words FROM again GROUP BY 1
), f AS (
    SELECT rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
           CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM w LEFT JOIN lines USING (rid) LEFT JOIN cover USING (rid)
), m AS (
    SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed,
           CASE WHEN n_words > 0 THEN n_symbols / n_words END AS symbols_per_word, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines END AS dup_line_share,
           CASE WHEN n_words > 0 THEN n_repeat_words / n_words END AS repeat_word_share, CASE WHEN n_words > 0 THEN word_chars / n_words END AS chars_per_word
    FROM f
), stacked AS (
    SELECT lang, source, 'symbols_per_word' AS metric, symbols_per_word AS x FROM m WHERE NOT base_failed
    UNION ALL SELECT lang, source, 'dup_line_share', dup_line_share FROM m WHERE NOT base_failed
    UNION ALL SELECT lang, source, 'repeat_word_share', repeat_word_share FROM m WHERE NOT base_failed
    UNION ALL SELECT lang, source, 'chars_per_word', chars_per_word FROM m WHERE NOT base_failed
), sketch AS (
    SELECT lang, source, metric, CASE WHEN coalesce(x, 0) > 0 THEN CAST(ceil(ln(x) / ln(1.05::DOUBLE)) AS BIGINT) ELSE -100000 END AS cell, count(*) AS n FROM stacked GROUP BY ALL
), levels AS (
    SELECT 1 AS level, lang, source, metric, cell, sum(n) AS n FROM sketch GROUP BY ALL
    UNION ALL SELECT 2, lang, NULL, metric, cell, sum(n) FROM sketch GROUP BY ALL
    UNION ALL SELECT 3, NULL, NULL, metric, cell, sum(n) FROM sketch GROUP BY ALL
), ranked AS (
    SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM levels
), quart AS (
    SELECT level, lang, source, metric, max(total) AS docs, min(cell) FILTER (upto * 4 >= total) AS c1, min(cell) FILTER (upto * 4 >= total * 2) AS c2, min(cell) FILTER (upto * 4 >= total * 3) AS c3, min(cell) FILTER (upto * 10 >= total * 9) AS c4
    FROM ranked GROUP BY ALL
), value AS (
    SELECT level, lang, source, metric, docs, CASE WHEN c1 > -100000 THEN 2 * pow(1.05::DOUBLE, c1) / 2.05::DOUBLE ELSE 0 END AS q1,
           CASE WHEN c2 > -100000 THEN 2 * pow(1.05::DOUBLE, c2) / 2.05::DOUBLE ELSE 0 END AS q2, CASE WHEN c3 > -100000 THEN 2 * pow(1.05::DOUBLE, c3) / 2.05::DOUBLE ELSE 0 END AS q3,
           CASE WHEN c4 > -100000 THEN 2 * pow(1.05::DOUBLE, c4) / 2.05::DOUBLE ELSE 0 END AS q90 FROM quart
), used AS (
    SELECT o.lang, o.source, o.metric, CASE WHEN o.docs >= 200 THEN o.q1 WHEN l.docs >= 200 THEN l.q1 ELSE a.q1 END AS q1,
           CASE WHEN o.docs >= 200 THEN o.q2 WHEN l.docs >= 200 THEN l.q2 ELSE a.q2 END AS q2, CASE WHEN o.docs >= 200 THEN o.q3 WHEN l.docs >= 200 THEN l.q3 ELSE a.q3 END AS q3,
           CASE WHEN o.docs >= 200 THEN o.q90 WHEN l.docs >= 200 THEN l.q90 ELSE a.q90 END AS q90
    FROM (SELECT * FROM value WHERE level = 1) o JOIN (SELECT * FROM value WHERE level = 2) l USING (lang, metric) JOIN (SELECT * FROM value WHERE level = 3) a ON a.metric = o.metric
), fence AS (
    SELECT lang, source,
           max(q3 + 4 * greatest(q3 - q1, q90 - q2, q2 * 0.25::DOUBLE, 0.03::DOUBLE)) FILTER (metric = 'symbols_per_word') AS h_symbols,
           max(q3 + 4 * greatest(q3 - q1, q90 - q2, q2 * 0.25::DOUBLE, 0.05::DOUBLE)) FILTER (metric = 'dup_line_share') AS h_lines,
           max(q3 + 4 * greatest(q3 - q1, q90 - q2, q2 * 0.25::DOUBLE, 0.03::DOUBLE)) FILTER (metric = 'repeat_word_share') AS h_repeat,
           max(q3 + 5 * greatest(q3 - q1, q90 - q2, q2 * 0.12::DOUBLE, 0.4::DOUBLE)) FILTER (metric = 'chars_per_word') AS h_chars,
           max(q1 - 5 * greatest(q3 - q1, q90 - q2, q2 * 0.12::DOUBLE, 0.4::DOUBLE)) FILTER (metric = 'chars_per_word') AS l_chars
    FROM used GROUP BY 1, 2
), judged AS (
    SELECT m.*, concat_ws(',', CASE WHEN symbols_per_word > h_symbols THEN 'symbols_per_word' END, CASE WHEN dup_line_share > h_lines THEN 'dup_line_share' END,
           CASE WHEN repeat_word_share > h_repeat THEN 'repeat_word_share' END, CASE WHEN chars_per_word > h_chars OR chars_per_word < l_chars THEN 'chars_per_word' END) AS failed
    FROM m LEFT JOIN fence USING (lang, source)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed, NOT base_failed AND failed = '' AS kept FROM judged
