WITH part AS (
    SELECT page_id, url,
           translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages
), ruled AS (
    SELECT *,
           CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
           CASE WHEN regexp_matches(url, '(?i)(^|[^a-z0-9_.%-])education([^a-z0-9_.%-]|$)') THEN '^education^'
                WHEN regexp_matches(url, '(?i)^[^:/?#]*://([^/?#]*\.)?spam-farm\.') THEN '||spam-farm.'
                WHEN regexp_matches(url, '(?i)^[^:/?#]*://([^/?#]*\.)?adult-x\.') THEN '||adult-x.'
                WHEN regexp_matches(url, '(?is)^[^:/?#]*://([^/?#]*\.)?casino.*\.') THEN '||casino*.'
                WHEN regexp_matches(url, '(?i)[^a-z0-9_.%-]casino([^a-z0-9_.%-]|$)') THEN '^casino^'
                WHEN regexp_matches(url, '(?i)[^a-z0-9_.%-]poker([^a-z0-9_.%-]|$)') THEN '^poker^'
                WHEN regexp_matches(url, '(?i)[^a-z0-9_.%-]porn([^a-z0-9_.%-]|$)') THEN '^porn^'
                WHEN regexp_matches(url, '(?i)[^a-z0-9_.%-]xxx([^a-z0-9_.%-]|$)') THEN '^xxx^'
                WHEN url ILIKE '%/cart/%' THEN '/cart/'
                WHEN regexp_matches(url, '(?i)/login([^a-z0-9_.%-]|$)') THEN '/login^'
                WHEN url ILIKE '%?s=%&sort=%' THEN '?s=*&sort=' END AS pattern
    FROM part
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN pattern IS NULL OR pattern = '^education^' THEN 'allow' ELSE 'block' END AS verdict,
       CASE WHEN rule IS NULL THEN pattern END AS matched_pattern
FROM ruled
