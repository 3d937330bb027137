"""Queries that streams answer, too."""

from __future__ import annotations

from mnemodex.plans.catalogue import query
from mnemodex.sources.model import table
from mnemodex.streaming import activity


@query("activity_spans", """
WITH s AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 43200000000 THEN 0 ELSE 1 END AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS span FROM s)
SELECT user_id, min(ts) AS first, max(ts) AS last, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM n GROUP BY user_id, span""")
def activity_spans(spark, sf_dir):
    """Spans of each user's activity, broken by 12 hours of silence."""
    return activity.spans(table(spark, sf_dir, "events"), 12 * 3600)
