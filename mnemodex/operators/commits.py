"""A log of commits over several tables: which parts every table has, at the last commit or an earlier one.

A log has (number, id, at, kind, n, tables, dropped), a row for each commit. ``tables`` lists only the tables that the commit changed, each with all its parts; a table
without parts is gone. ``dropped`` are parts that no table has any more from this commit on. Parts never change, so a state of the log is a state of all tables at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG = "number long, id string, at timestamp, kind string, n long, tables array<struct<name:string,parts:array<string>>>, dropped array<string>"


class Conflict(RuntimeError):
    """Another writer has made a commit since this one began."""


def state(log: DataFrame, upto: int | None = None) -> DataFrame:
    """(name, parts, number): of each table the parts that the last commit gave it that names it, among those up to ``upto``.

    Of two commits of one number only that of the smaller id counts. The log is read once; there is one row for each table and commit that names it.
    """
    if upto is not None:
        log = log.filter(F.col("number") <= upto)
    one = log.groupBy("number").agg(F.min_by("tables", "id").alias("tables")).select("number", F.inline("tables"))
    last = one.groupBy("name").agg(F.max_by("parts", "number").alias("parts"), F.max("number").alias("number"))
    return last.filter(F.size("parts") > 0)


def droppable(log: DataFrame, keep: int) -> DataFrame:
    """(part): parts that none of the last ``keep`` commits' states has."""
    last = log.agg(F.max("number").alias("last"))
    old = log.join(F.broadcast(last)).filter(F.col("number") <= F.col("last") - keep + 1)  # one row
    return old.select(F.explode("dropped").alias("part")).distinct()


#: What each version of a store's tables added: columns of a table, with the value that rows of before have for them (SQL over the columns of before).
MIGRATIONS = [
    {},
    {"sections": {"deleted": "false", "suppressed": "false", "forget_reason": "cast(null as string)"}},
]


def upgraded(rows: DataFrame, table: str, schema: str) -> DataFrame:
    """A part of any version as the latest has it: each migration's columns that it lacks are added in order, and columns that no version has are left out."""
    for added in MIGRATIONS:
        for column, value in added.get(table, {}).items():
            if column not in rows.columns:
                rows = rows.withColumn(column, F.expr(value))
    fields = rows.sparkSession.createDataFrame([], schema).schema
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def version(columns: dict[str, list[list[str]]]) -> int:
    """The version of a store: the last migration up to which all parts have all columns; ``columns`` are those of each table's parts."""
    done = 0
    for n, added in enumerate(MIGRATIONS, 1):
        if any(set(new) - set(part) for table, new in added.items() for part in columns.get(table, [])):
            break
        done = n
    return done
