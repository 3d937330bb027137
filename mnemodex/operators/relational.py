"""Visibility, rollups, set differences, keyed updates: what the engine does to its tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemodex.functions import text


def active(rows: DataFrame, *marks: str) -> DataFrame:
    """Rows of which none of the marks (columns such as deleted, suppressed) is set."""
    return rows.filter(~reduce(or_, [F.coalesce(F.col(m), F.lit(False)) for m in marks]))


def like_any(rows: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    low = F.lower(F.col(column))
    return rows.filter(reduce(or_, [low.like(f"%{t}%") for t in wanted], F.lit(False)))


def visible(docs: DataFrame, inactive: DataFrame, on: list[str]) -> DataFrame:
    """``docs`` without those that ``inactive`` lists; null keys never match."""
    return docs.join(inactive.select(*on), on, "left_anti")


def module_rollup(sections: DataFrame) -> DataFrame:
    """Files and sections for each top-level module and role. Nulls count as unknown, in one group with it."""
    grouped = sections.groupBy(text.top_module(F.col("path")).alias("module_path"), F.coalesce("source_role", F.lit("unknown")).alias("source_role"))
    return grouped.agg(F.countDistinct("path").alias("file_count"), F.count(F.lit(1)).alias("section_count"))


def counts(**tables: DataFrame) -> DataFrame:
    """(name, n): the number of rows of each table, as one query."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "path", digest: str = "content_hash") -> DataFrame:
    """(key, change): added, changed, deleted or unchanged, from two snapshots with one row a key."""
    b = before.select(F.col(key).alias(key), F.col(digest).alias("_before"), F.lit(True).alias("_was"))
    a = after.select(F.col(key).alias(key), F.col(digest).alias("_after"), F.lit(True).alias("_is"))
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "deleted").when(F.col("_before").eqNullSafe(F.col("_after")), "unchanged").otherwise("changed")
    return b.join(a, key, "full_outer").select(key, change.alias("change"))


def unhashed(now: DataFrame, before: DataFrame, key: str = "path", digest: str = "content_hash") -> DataFrame:
    """``now`` (key, size, mtime) with the digest of before where size and mtime are as they were, else null: those have to be read."""
    old = before.select(F.col(key), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col(digest).alias("_digest"))
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime"))
    return now.join(old, key, "left").withColumn(digest, F.when(same, F.col("_digest"))).drop("_size", "_mtime", "_digest")


def reuse_hashes(now: DataFrame, before: DataFrame, contents: DataFrame, key: str = "path", digest: str = "content_hash") -> DataFrame:
    """``now`` (key, size, mtime) with a digest: the one before where size and mtime are as they were, else that of ``contents`` (key, content)."""
    hashed = contents.select(key, F.sha2("content", 256).alias("_new"))
    return unhashed(now, before, key, digest).join(hashed, key, "left").withColumn(digest, F.coalesce(digest, "_new")).drop("_new")


def dedupe_batch(batch: DataFrame, known: DataFrame, digest: str, order: str) -> DataFrame:
    """The first row of each digest that no known row has."""
    first = batch.withColumn("_n", F.row_number().over(Window.partitionBy(digest).orderBy(order))).filter("_n = 1").drop("_n")
    return first.join(known.select(digest).distinct(), digest, "left_anti")


def latest_wins(current: DataFrame, changes: DataFrame, keys: list[str], version: str | None = None, keep: list[str] = ()) -> DataFrame:
    """Upsert: a changed row replaces the current one of its key, whose ``keep`` columns (such as created_at) stay.

    Of several changes of one key the one with the largest ``version`` wins, a column that ``changes`` has besides; without
    it there must be one change for each key.
    """
    plain = [c for c in changes.columns if c != version]
    last = changes
    if version:
        last = changes.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in plain if c not in keys]), version).alias("_last")).select(*keys, "_last.*")
    stay = current.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_was_{c}") for c in keep])
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys])
    held = last.join(stay, same, "left")
    new = held.select(*[F.coalesce(f"_was_{c}", c).alias(c) if c in keep else F.col(c) for c in current.columns])
    return without(current, last, keys).select(*current.columns).unionByName(new)


def mark(rows: DataFrame, chosen: Column, flag: str, reason: str | None) -> DataFrame:
    """Soft state: ``flag`` and forget_reason of the chosen rows that don't have it yet; the reasons of others stay."""
    hit = F.coalesce(chosen, F.lit(False)) & ~F.coalesce(F.col(flag), F.lit(False))
    before = F.col("forget_reason") if "forget_reason" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("forget_reason", F.when(hit, F.lit(reason)).otherwise(before)).withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) | hit)


#: What a suppression is told by.
SUPPRESSED = ["path", "anchor", "content_hash"]


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def new_suppressions(sections: DataFrame, ledger: DataFrame) -> DataFrame:
    """(path, anchor, content_hash, reason, created_at): what of ``sections`` is deleted or suppressed and not in the ledger yet, a row for each key.

    ``sections`` has path, anchor, content_hash, deleted, suppressed, forget_reason and updated_at. A null anchor is ''; sections without a path have no key. Of several
    sections of one key the latest counts.
    """
    hidden = sections.filter(F.coalesce("deleted", F.lit(False)) | F.coalesce("suppressed", F.lit(False))).filter("path is not null")
    keyed = hidden.withColumn("anchor", F.coalesce("anchor", F.lit("")))
    latest = F.max_by(F.struct("forget_reason", "updated_at"), F.struct("updated_at", F.coalesce("forget_reason", F.lit("")))).alias("x")
    rows = keyed.groupBy(*SUPPRESSED).agg(latest).select(*SUPPRESSED, F.col("x.forget_reason").alias("reason"), F.col("x.updated_at").alias("created_at"))
    return without(rows, ledger, SUPPRESSED)


def unsuppressed(sections: DataFrame, ledger: DataFrame) -> DataFrame:
    """``sections`` whose path, anchor and content the ledger doesn't hold. A change of the content is a new key, and so comes in."""
    key = [F.col("path").alias("_p"), F.col("anchor").alias("_a"), F.col("content_hash").alias("_h")]
    same = (F.col("path") == F.col("_p")) & (F.coalesce("anchor", F.lit("")) == F.col("_a")) & (F.col("content_hash") == F.col("_h"))
    return sections.join(ledger.select(*key).distinct(), same, "left_anti")


def first_occurrence(rows: DataFrame, key: str, *order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")
