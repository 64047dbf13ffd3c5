"""Source spans of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorewright.operators.spans import LEAST, MOST, source_spans
from lorewright.plans.base import registrar, table

QUERIES: dict = {}
register = registrar(QUERIES)


@register(rf"""WITH RECURSIVE cp AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS c FROM documents), s0 AS (SELECT doc_id, string_split(regexp_replace(c, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)) AS xs FROM cp),
  se AS (SELECT doc_id, i, trim(xs[i + 1]) AS s FROM (SELECT doc_id, xs, unnest(range(len(xs))) AS i FROM s0)),
  sl AS (SELECT doc_id, i, 0 AS k, s AS rest, '' AS chunk FROM se UNION ALL SELECT doc_id, i, k + 1, CASE WHEN cut IS NULL THEN '' ELSE trim(substr(rest, cut + 1)) END, CASE WHEN cut IS NULL THEN rest ELSE trim(left(rest, cut)) END
    FROM (SELECT *, CASE WHEN length(rest) > {MOST} THEN CASE WHEN length(regexp_replace(left(rest, {MOST + 1}), '[^ ]*$', '')) - 1 >= {LEAST} THEN length(regexp_replace(left(rest, {MOST + 1}), '[^ ]*$', '')) - 1 ELSE {MOST} END END AS cut FROM sl WHERE rest <> '')),
  sg AS MATERIALIZED (SELECT doc_id, chunk, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS n FROM sl WHERE chunk <> ''), tt AS (SELECT doc_id, max(n) AS n FROM sg GROUP BY doc_id),
  mg AS (SELECT doc_id, 1::BIGINT AS n, chunk AS cur, 1::BIGINT AS span, NULL::VARCHAR AS done FROM sg WHERE n = 1 UNION ALL SELECT m.doc_id, g.n, CASE WHEN fits THEN cur || ' ' || g.chunk ELSE g.chunk END, CASE WHEN fits THEN span ELSE span + 1 END, CASE WHEN NOT fits THEN cur END
    FROM (SELECT mg.*, length(cur) < {LEAST} AND length(cur) + 1 + length(x.chunk) <= {MOST} AS fits FROM mg JOIN sg x ON x.doc_id = mg.doc_id AND x.n = mg.n + 1) m JOIN sg g ON g.doc_id = m.doc_id AND g.n = m.n + 1),
  sp AS (SELECT doc_id, span - 1 AS span, done AS text FROM mg WHERE done IS NOT NULL UNION ALL SELECT doc_id, span, cur FROM mg JOIN tt USING (doc_id, n)),
  ls AS (SELECT *, span = max(span) OVER (PARTITION BY doc_id) AS last, lag(text) OVER (PARTITION BY doc_id ORDER BY span) AS prev, lead(text) OVER (PARTITION BY doc_id ORDER BY span) AS nxt, max(span) OVER (PARTITION BY doc_id) AS top FROM sp)
  SELECT doc_id, span, CASE WHEN span = top - 1 AND length(nxt) < {LEAST} AND length(text) + 1 + length(nxt) <= {MOST} THEN text || ' ' || nxt ELSE text END AS text FROM ls
  WHERE NOT (last AND prev IS NOT NULL AND length(text) < {LEAST} AND length(prev) + 1 + length(text) <= {MOST})""")
def bounded_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in spans of 200 to 600 characters."""
    return source_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
