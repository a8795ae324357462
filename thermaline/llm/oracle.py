"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

FILTER_ORDERS = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    min(doc_id) OVER (PARTITION BY t) AS first_id
  FROM texts
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id
), failed AS (
  SELECT part,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN split.doc_id > first_id THEN 'E' ELSE '' END AS fails,
    coalesce(good, 0) AS good, coalesce(bad, 0) AS bad
  FROM split LEFT JOIN known ON split.doc_id = known.doc_id
), sets AS (
  SELECT part, fails, count(*) AS n, sum(good) AS n_good, sum(bad) AS n_bad FROM failed GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), removals AS (
  SELECT part, filter_order, fails, n, n_good, n_bad,
    list_min(list_filter([1, 2, 3, 4, 5], lambda s: contains(fails, substr(filter_order, s, 1)))) AS gone
  FROM sets, orders
), steps AS (
  SELECT part, filter_order, step,
    sum(CASE WHEN gone IS NULL OR gone > step THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone < step AND contains(fails, substr(filter_order, step, 1)) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = substr(filter_order, step, 1) THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN gone = step THEN n_good ELSE 0 END) AS good_lost,
    sum(CASE WHEN gone = step THEN n_bad ELSE 0 END) AS toxic_lost
  FROM removals, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
  GROUP BY part, filter_order, step
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley
FROM steps
"""

DYNAMIC_ITEMSETS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), occurrences AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM split
  UNION ALL SELECT lang, 2, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda t: t[1] || ' ' || t[2]))
  FROM split WHERE len(w) >= 2
  UNION ALL SELECT lang, 3, unnest(list_transform(list_zip(w[:-3], w[2:-2], w[3:]), lambda t: t[1] || ' ' || t[2] || ' ' || t[3]))
  FROM split WHERE len(w) >= 3
), f AS MATERIALIZED (
  SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS c FROM occurrences GROUP BY lang, size, phrase
), totals AS (
  SELECT lang, sum(c) AS n FROM f WHERE size = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT lang, size, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2 AND c >= 10
), cuts AS MATERIALIZED (
  SELECT lang, size, phrase, a, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM candidates
  UNION ALL
  SELECT lang, size, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM candidates WHERE size = 3
), scored AS (
  SELECT cuts.lang, cuts.size, cuts.phrase, a, k, x.c AS l, y.c AS r, (1000000 * a * a) // (x.c * y.c) AS score
  FROM cuts
  JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.head
  JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.tail
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM candidates WHERE size = 3
  ) GROUP BY lang, phrase
), kept AS (
  SELECT best.* FROM best LEFT JOIN inner_parts i ON i.lang = best.lang AND i.phrase = best.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * best.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT ranked.lang, CAST(rank AS INT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
  CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_filter_orders": FILTER_ORDERS, "op13_dynamic_itemsets": DYNAMIC_ITEMSETS}
