"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemodex.llm.common import cut

#: A node with more than one in so many of all rows, and more than so many rows, is joined apart from the others.
HUB_SHARE, HUB_ROWS = 500, 50_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _with_least(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (u, v), ``n`` of them at most, with the least v of each u as m.

    Hubs have a large share of the rows each, so there are fewer than ``HUB_SHARE`` of them: their minima are sent to
    the rows, and no task gets a hub's rows as one key.
    """
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    most = max(HUB_ROWS, n // HUB_SHARE)
    if n <= most:
        return rows.join(least.drop("n"), "u")
    hubs = least.filter(F.col("n") > most).select("u", F.col("m").alias("hub_m"))
    marked = rows.join(F.broadcast(hubs), "u", "left")
    few = marked.filter("hub_m is null").select("u", "v").join(least.filter(F.col("n") <= most).drop("n"), "u")
    return few.unionByName(marked.filter("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return (node, component) for every node that has an edge to a smaller one.

    ``component`` is the smallest node that can be reached. A node that is the
    smallest of its component, or has no edge, is not in the result. Loops and
    nulls in ``edges`` are ignored. Each round replaces every node's neighbours by
    the smallest of them (first towards larger nodes, then towards smaller ones),
    which needs a logarithmic number of rounds; a round is two aggregations and
    two joins, and its result is written to the checkpoint folder.
    """
    e = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).filter("_a <> _b")
    e = cut(e.select(F.greatest("_a", "_b").alias("u"), F.least("_a", "_b").alias("v")).distinct())
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        known = _with_least(both, 2 * before[0])
        large = known.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        known = _with_least(large, 2 * before[0])
        # A row's own minimum is kept as an edge of u, and the others move to it.
        small = known.select(F.when(F.col("v").eqNullSafe(F.col("m")), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
