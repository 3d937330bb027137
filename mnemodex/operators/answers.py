"""One answer to a task: a brief, what to inspect first, the recalled rows, and the relations that hold or held around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemodex.operators import search

#: Rows of the graph and of its history that are shown unless all are asked for.
GRAPH_ROWS, HISTORY_ROWS = 6, 4


def _placed(rows: DataFrame, *order: Column) -> DataFrame:
    """Short lists in one order."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def answer(memories: DataFrame, around: DataFrame, past: DataFrame, sources: bool = False) -> DataFrame:
    """(part, position, ref, line, score) with the parts brief, target, memory, graph and history.

    ``memories`` (target_type, id, path, score, excerpt) fit a budget already, ``around`` (see ``graph.context``) are relations that hold, ``past`` (see ``graph.history``) those that
    did; a past relation of several origins is there once. Without ``sources`` the first ``GRAPH_ROWS`` and ``HISTORY_ROWS`` of the last two are shown; the brief counts all.
    No memories: the quality is weak, and the brief says that nothing was found.
    """
    ident = F.col("id").cast("string")
    found = _placed(memories, F.desc("score"), F.col("target_type"), ident)
    targets = _placed(search.primary_targets(memories), F.desc("score"), F.col("target"))
    graph = _placed(around, F.desc("score"), F.col("relation_id"))
    once = past.groupBy("relation_id").agg(F.min_by(F.struct("subject_name", "predicate", "object_name", "status", "valid_to"), F.struct("n", "origin_id")).alias("r"), F.min("n").alias("n"))
    history = _placed(once.select("relation_id", "r.*", "n"), F.col("n"), F.col("relation_id"))

    # The brief is put together of one row each.
    listed = lambda rows, value: F.transform(F.array_sort(F.collect_list(F.struct("position", value.alias("v")))), lambda x: x["v"])
    counts = found.groupBy("target_type").agg(F.min("position").alias("position"), F.count(F.lit(1)).alias("n"))
    facts = [
        search.quality(memories).select("quality"), targets.filter(F.col("position") <= 3).agg(listed(targets, F.col("target")).alias("first")),
        counts.agg(listed(counts, F.concat_ws(" ", F.col("n").cast("string"), "target_type")).alias("kinds")),
        graph.agg(F.count(F.lit(1)).alias("holding")), history.agg(F.count(F.lit(1)).alias("held")),
    ]
    one = reduce(lambda a, b: a.join(b, "k"), [f.withColumn("k", F.lit(1)) for f in facts])
    say = F.array(
        F.concat(F.lit("Quality: "), "quality", F.lit(".")),
        F.when(F.size("first") > 0, F.concat(F.lit("Inspect first: "), F.array_join("first", ", "))),
        F.when(F.size("kinds") > 0, F.concat(F.lit("Evidence: "), F.array_join("kinds", ", "), F.lit("."))).otherwise("Evidence: none found."),
        F.when(F.col("holding") + F.col("held") > 0, F.concat(F.lit("Relations: "), F.col("holding").cast("string"), F.lit(" active, "), F.col("held").cast("string"), F.lit(" historical."))),
    )
    brief = one.select(F.posexplode(F.array_compact(say)).alias("n", "line")).withColumn("position", F.col("n") + 1)

    def part(rows: DataFrame, name: str, ref: Column, line: Column, score: Column) -> DataFrame:
        return rows.select(F.lit(name).alias("part"), "position", ref.cast("string").alias("ref"), line.alias("line"), score.cast("double").alias("score"))

    none = F.lit(None)
    if not sources:
        graph, history = graph.filter(F.col("position") <= GRAPH_ROWS), history.filter(F.col("position") <= HISTORY_ROWS)
    parts = [
        part(brief, "brief", none, F.col("line"), none), part(targets, "target", F.col("target"), F.col("target"), F.col("score")),
        part(found, "memory", F.concat_ws(":", "target_type", ident), F.col("excerpt"), F.col("score")),
        part(graph, "graph", F.col("relation_id"), F.concat_ws(" - ", "origin_id", "entity_id"), F.col("score")),
        part(history, "history", F.col("relation_id"), F.concat("subject_name", F.lit(" "), "predicate", F.lit(" "), "object_name", F.lit(" ("), "status", F.lit(")")), none),
    ]
    return reduce(DataFrame.unionByName, parts)
