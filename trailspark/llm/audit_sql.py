"""SQL of the filter interaction audit: every order is applied to the documents, without any potential."""

SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
first AS (SELECT t, min(doc_id) AS first_id FROM w GROUP BY t),
label AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(doc_id > first_id, false)} AS f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w JOIN first USING (t) LEFT JOIN label USING (doc_id)),
cells AS MATERIALIZED (
  SELECT part, [f.A, f.B, f.C, f.D, f.E] AS f, good, toxic, count(*) AS n FROM fails GROUP BY ALL),
i AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT o, array_to_string([('ABCDE')[x] for x in o], '') AS filter_order, s.i AS step, o[s.i] AS x FROM orders, i s),
applied AS (
  SELECT part, filter_order, step, x, n, good, toxic, f[x] AS failing, len([y for y in o[1:step - 1] if f[y]]) > 0 AS gone,
    len([y for y in f if y]) = 1 AS alone
  FROM cells, steps),
counted AS (
  SELECT part, filter_order, step, x,
    coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (failing AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (failing AND gone), 0) AS redundant, coalesce(sum(n) FILTER (failing AND alone), 0) AS unique_fails,
    coalesce(sum(n) FILTER (failing AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (failing AND NOT gone AND toxic), 0) AS toxic_lost
  FROM applied GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM counted
"""
