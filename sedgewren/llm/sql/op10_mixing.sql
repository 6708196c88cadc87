WITH d AS (
    SELECT doc_id, lang, source, coalesce(lang, '') AS k1, coalesce(source, '') AS k2,
           'domain' || coalesce(TRY_CAST(regexp_extract(source, '[0-9]+$') AS INTEGER) % 4, 0) AS k0,
           coalesce(CAST(doc_id AS VARCHAR), '') AS ident, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
    FROM documents
), leaf AS (
    SELECT k0, k1, k2, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL
), root AS (
    SELECT CAST(least(floor(sum(tokens) * 0.5::DOUBLE), sum(tokens) * 3) AS DOUBLE) AS budget FROM leaf
), a0 AS (
    SELECT k0, CAST(sum(tokens) * 3 AS DOUBLE) AS capacity, 1.0::DOUBLE AS weight, (SELECT budget FROM root) AS parent FROM leaf GROUP BY 1 HAVING sum(tokens) > 0
), b0 AS (
    SELECT *, parent - coalesce(sum(capacity) OVER (ORDER BY capacity / weight, k0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              >= sum(weight) OVER (ORDER BY capacity / weight, k0 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * (capacity / weight) AS is_full FROM a0
), c0 AS (
    SELECT k0, CASE WHEN is_full THEN capacity ELSE (parent - coalesce(sum(capacity) FILTER (is_full) OVER (), 0)) / sum(weight) FILTER (NOT is_full) OVER () * weight END AS budget FROM b0
), a1 AS (
    SELECT k0, k1, capacity, CASE k1 WHEN 'en' THEN 4.0::DOUBLE WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS weight, budget AS parent
    FROM (SELECT k0, k1, CAST(sum(tokens) * 3 AS DOUBLE) AS capacity FROM leaf GROUP BY ALL HAVING sum(tokens) > 0) JOIN c0 USING (k0)
), b1 AS (
    SELECT *, parent - coalesce(sum(capacity) OVER (PARTITION BY k0 ORDER BY capacity / weight, k1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              >= sum(weight) OVER (PARTITION BY k0 ORDER BY capacity / weight, k1 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * (capacity / weight) AS is_full FROM a1
), c1 AS (
    SELECT k0, k1, CASE WHEN is_full THEN capacity ELSE (parent - coalesce(sum(capacity) FILTER (is_full) OVER (PARTITION BY k0), 0)) / sum(weight) FILTER (NOT is_full) OVER (PARTITION BY k0) * weight END AS budget FROM b1
), a2 AS (
    SELECT k0, k1, k2, CAST(tokens * 3 AS DOUBLE) AS capacity, 1.0::DOUBLE AS weight, budget AS parent FROM leaf JOIN c1 USING (k0, k1) WHERE tokens > 0
), b2 AS (
    SELECT *, parent - coalesce(sum(capacity) OVER (PARTITION BY k0, k1 ORDER BY capacity / weight, k2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              >= sum(weight) OVER (PARTITION BY k0, k1 ORDER BY capacity / weight, k2 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * (capacity / weight) AS is_full FROM a2
), c2 AS (
    SELECT k0, k1, k2, CASE WHEN is_full THEN capacity ELSE (parent - coalesce(sum(capacity) FILTER (is_full) OVER (PARTITION BY k0, k1), 0)) / sum(weight) FILTER (NOT is_full) OVER (PARTITION BY k0, k1) * weight END AS budget FROM b2
), plan AS (
    SELECT k0, k1, k2, tokens, CAST(floor(budget + 1e-6::DOUBLE) AS BIGINT) AS target, CAST(least(floor(floor(budget + 1e-6::DOUBLE) / tokens), 3) AS INTEGER) AS whole FROM leaf JOIN c2 USING (k0, k1, k2)
), o AS (
    SELECT d.*, whole, target - whole * tokens AS part, md5('7:' || whole || ':' || ident) AS key FROM d JOIN plan USING (k0, k1, k2)
), cum AS (
    SELECT *, sum(n_tokens) OVER (PARTITION BY k0, k1, k2 ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM o
), epochs AS (
    SELECT *, whole + CASE WHEN whole < 3 AND upto <= part THEN 1 ELSE 0 END AS n FROM cum
)
SELECT doc_id, lang, source, CAST(unnest(range(n)) AS INTEGER) AS mix_epoch, n_tokens AS mix_tokens FROM epochs WHERE n > 0
