"""Scores and dates as Column functions. ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemodex.functions.text import bounded


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def recency(updated: Column, now: str, base: int = 20) -> Column:
    """``base`` less the whole days since ``updated``, at least 0; unknown dates give 0."""
    days = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(updated.cast("timestamp"))) / F.lit(86_400_000_000.0))
    return F.coalesce(F.greatest(F.lit(0), F.lit(base) - days), F.lit(0)).cast("long")


def result_score(lexical: Column, vector: Column, confidence: Column, fresh: Column, tokens: Column) -> Column:
    bounded_confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence.cast("double")))
    return half_up(lexical * 100 + F.coalesce(vector, F.lit(0.0)) * 60 + bounded_confidence * 20 + fresh - F.ceil(tokens / 120))


def importance(value: Column) -> Column:
    return F.coalesce(value / 5, F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a vector has no length."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def distance_score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / 2))


# The points in ``role_delta``, ``highlight_score`` and ``guidance_score``.


def role_delta(role: Column, path: Column, implementation: bool, prefers_agent: bool) -> Column:
    """What a source's role adds to its score when a task is recalled."""
    out = F.when(role.isin("agent_reference", "generated", "agent_config"), 20 if prefers_agent else -60)
    out = out.when(role.isin("app_code", "test_code", "package_config"), 15).when(role == "product_doc", -10 if implementation else 10).otherwise(0)
    if implementation:
        out = out + F.when(path.startswith("src/"), 25).otherwise(0) + F.when(path.endswith(".test.ts"), 10).otherwise(0)
    return F.coalesce(out, F.lit(0))


def highlight_score(kind: Column, role: Column, fresh: Column, tokens: Column) -> Column:
    by_kind = F.when(kind == "module", 80).when(kind == "section", 60).otherwise(40)
    by_role = F.when(role == "app_code", 35).when(role == "package_config", 30).when(role == "test_code", 25).when(role == "product_doc", 15).otherwise(5)
    return (by_kind + by_role + fresh - F.ceil(tokens / 160)).cast("long")


#: Words that raise or lower the rank of a note as guidance.
GUIDANCE_STRONG = "must|never|required|default|prefer|avoid|should"
GUIDANCE_TOPIC = "user-facing|contract|schema|prompt|tool|mcp|cli|memory|save|recall|warm-up|warm up"
GUIDANCE_PLAN = "readiness|release plan|milestone|checklist|tracked in"
GUIDANCE_LOG_START = "patched|added|removed|renamed|moved|extracted|updated|implemented|fixed|reverted"
GUIDANCE_LOG = "now exposes|now includes|now resolves|no longer exposes|was not persisted|moved sql query logic|added regression test"


def guidance_kind(kind: Column) -> Column:
    return F.when(kind == "constraint", "constraint").when(kind == "decision", "decision").when(kind == "preference", "convention")


def guidance_score(kind: Column, text: Column) -> Column:
    low = F.lower(text)
    has = lambda words, points: F.when(low.rlike(bounded(words)), points).otherwise(0)
    start = F.when(kind == "constraint", 90).when(kind == "convention", 70).otherwise(60)
    size = F.when(F.length(text) <= 180, 8).when(F.length(text) > 280, -12).otherwise(0)
    log = low.rlike(f"^({GUIDANCE_LOG_START})([^a-z0-9_]|$)") | low.rlike(bounded(GUIDANCE_LOG))
    return (start + has(GUIDANCE_STRONG, 18) + has(GUIDANCE_TOPIC, 8) + size + has(GUIDANCE_PLAN, -20) + F.when(log, -80).otherwise(0)).cast("long")
