"""The whole answer to a task."""

from __future__ import annotations

from mnemodex.operators import answers
from mnemodex.plans import catalogue as c
from mnemodex.plans import composed  # noqa: F401
from mnemodex.plans.catalogue import ORACLES, query


@query("recall_answer", f"""
WITH m AS (SELECT * FROM ({ORACLES['recall_package']})), a AS (SELECT * FROM ({ORACLES['graph_context']})), h AS (SELECT * FROM ({ORACLES['history_ranked']})),
found AS (SELECT *, row_number() OVER (ORDER BY score DESC, target_type, CAST(id AS VARCHAR)) AS position FROM m),
t AS (SELECT coalesce(path, target_type || ':' || id) AS target, max(score) AS score FROM m GROUP BY 1),
targets AS (SELECT *, row_number() OVER (ORDER BY score DESC, target) AS position FROM t),
graph AS (SELECT *, row_number() OVER (ORDER BY score DESC, relation_id) AS position FROM a),
once AS (SELECT relation_id, arg_min(subject_name || ' ' || predicate || ' ' || object_name || ' (' || status || ')', (n, origin_id)) AS line, min(n) AS n FROM h GROUP BY relation_id),
past AS (SELECT *, row_number() OVER (ORDER BY n, relation_id) AS position FROM once),
kinds AS (SELECT target_type, count(*) AS n, min(position) AS position FROM found GROUP BY target_type),
said AS (
  SELECT 1 AS o, 'Quality: ' || (SELECT CASE WHEN max(score) >= 200 AND count(DISTINCT coalesce(path, CAST(id AS VARCHAR))) >= 2 THEN 'strong' WHEN max(score) >= 80 THEN 'partial' ELSE 'weak' END FROM m) || '.' AS line
  UNION ALL SELECT 2, 'Inspect first: ' || string_agg(target, ', ' ORDER BY position) FROM targets WHERE position <= 3 HAVING count(*) > 0
  UNION ALL SELECT 3, coalesce('Evidence: ' || string_agg(n || ' ' || target_type, ', ' ORDER BY position) || '.', 'Evidence: none found.') FROM kinds
  UNION ALL SELECT 4, 'Relations: ' || (SELECT count(*) FROM graph) || ' active, ' || (SELECT count(*) FROM past) || ' historical.' WHERE (SELECT count(*) FROM graph) + (SELECT count(*) FROM past) > 0)
SELECT 'brief' AS part, CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS position, CAST(NULL AS VARCHAR) AS ref, line, CAST(NULL AS DOUBLE) AS score FROM said
UNION ALL SELECT 'target', CAST(position AS INTEGER), target, target, CAST(score AS DOUBLE) FROM targets WHERE position <= 5
UNION ALL SELECT 'memory', CAST(position AS INTEGER), target_type || ':' || id, excerpt, CAST(score AS DOUBLE) FROM found
UNION ALL SELECT 'graph', CAST(position AS INTEGER), relation_id, origin_id || ' - ' || entity_id, CAST(score AS DOUBLE) FROM graph WHERE position <= 6
UNION ALL SELECT 'history', CAST(position AS INTEGER), relation_id, line, NULL FROM past WHERE position <= 4""")
def recall_answer(spark, sf_dir):
    """A brief, targets, the rows that fit the budget, and relations that hold and held, in one table."""
    return answers.answer(c.recall_package(spark, sf_dir), c.graph_context(spark, sf_dir), c.history_ranked(spark, sf_dir))
