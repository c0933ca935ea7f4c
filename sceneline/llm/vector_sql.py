"""SQL of the iterative vector operators: Lloyd rounds in whole numbers, one after another."""

from __future__ import annotations


def lloyd(rounds: int) -> str:
    """CTEs that take p (r, part, x) and c0 (part, c, x) to c{rounds} and the assignment a{rounds} (r, part, x, c, d)."""
    out = []
    for t in range(rounds + 1):
        out.append(f"""a{t} AS MATERIALIZED (
  SELECT r, part, any_value(x) AS x, min(row(d, c))[2] AS c, min(d) AS d
  FROM (SELECT p.r, p.part, p.x, c.c, CAST(list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x) AS BIGINT) AS d FROM p JOIN c{t} c ON c.part = p.part)
  GROUP BY r, part
)""")
        if t < rounds:
            out.append(f"""m{t} AS MATERIALIZED (
  SELECT part, c, list(CAST(q AS DOUBLE) ORDER BY i) AS x FROM (
    SELECT part, c, i, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS q
    FROM (SELECT part, c, generate_subscripts(x, 1) AS i, CAST(unnest(x) AS BIGINT) AS v FROM a{t}) GROUP BY part, c, i
  ) GROUP BY part, c
), c{t + 1} AS MATERIALIZED (SELECT part, c, coalesce(m{t}.x, c{t}.x) AS x FROM c{t} LEFT JOIN m{t} USING (part, c))""")
    return ",\n".join(out)


def finite(where: str, scale: int) -> str:
    return f"""SELECT row_number() OVER () AS r, *, list_transform(embedding, lambda e: floor({scale} * CAST(e AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND {where} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0"""


SORT_MEANS = f"""
WITH v AS MATERIALIZED (
  {finite("len(embedding) = 64", 1024)}
), p AS (SELECT r, 0 AS part, x FROM v
), c0 AS MATERIALIZED (
  SELECT 0 AS part, row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS c, x
  FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v) ORDER BY h NULLS LAST, x LIMIT 8
),
{lloyd(10)},
s AS (SELECT c, sum(d) AS inertia FROM a10 GROUP BY c
), h AS (SELECT c, sha256(array_to_string(list_transform(x, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ',')) AS h FROM c10)
SELECT vec_id, CAST(a10.c AS INTEGER) AS cluster, a10.d AS distance, CAST(s.inertia AS BIGINT) AS cluster_inertia,
  CAST((SELECT sum(inertia) FROM s) AS BIGINT) AS inertia, h.h AS centroid_sha256
FROM a10 JOIN v USING (r) JOIN s ON s.c = a10.c JOIN h ON h.c = a10.c
"""

FILTERING = f"""
WITH v AS MATERIALIZED (
  {finite("len(embedding) > 0", 4096)}
), p AS MATERIALIZED (SELECT r, part, x[part * (len(x) // 8) + 1 : (part + 1) * (len(x) // 8)] AS x FROM (SELECT r, x, unnest(range(8)) AS part FROM v)
), f AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS c, r FROM v ORDER BY vec_id NULLS LAST, x LIMIT 16
), c0 AS MATERIALIZED (SELECT part, c, x FROM p JOIN f USING (r)
),
{lloyd(6)},
e AS (SELECT r, string_agg(printf('%02x', c), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY r
), b AS (SELECT part, c, string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS t FROM (SELECT part, c, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM c6) GROUP BY part, c)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(t, ',' ORDER BY part, c)) FROM b) AS codebooks_sha256
FROM e JOIN v USING (r)
"""
