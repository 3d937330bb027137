"""The engine's tables, built from the tables at hand.

documents are sections, benchmark items are durable notes, conversations are diary entries, pages are
modules; labels say which sections are forgotten. Customers, suppliers, nations and regions are
entities, and foreign keys and orders their relations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemodex.functions import text

NOW = "2024-02-01 00:00:00"
KINDS = ["fact", "constraint", "decision", "preference", "insight", "procedure", "issue"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(doc_id, source):
    name = F.concat(source, F.lit("/f"), doc_id.cast("string"))
    shapes = [("src/", ".ts"), ("src/", ".test.ts"), ("docs/", ".md"), (".agents/", ".json"), ("lib/generated/", ".ts")]
    out = None
    for i, (before, after) in enumerate(shapes):
        value = F.concat(F.lit(before), name, F.lit(after))
        out = F.when(doc_id % 5 == i, value) if out is None else out.when(doc_id % 5 == i, value)
    return out


def _day(key):
    return F.timestamp_micros(F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) + (key % 40) * F.lit(86_400_000_000)).cast("timestamp_ntz")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("path", _path(F.col("doc_id"), F.col("source")))
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    docs = docs.join(marks, "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("id"), F.lit("section").alias("target_type"), "path", text.source_role(F.col("path")).alias("source_role"), "text",
        F.sha2("text", 256).alias("content_hash"), _day(F.col("doc_id")).alias("updated_at"),
        F.coalesce(F.col("quality") == 0, F.lit(False)).alias("deleted"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("suppressed"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("id"), F.element_at(kinds, (F.col("item_id") % 7 + 1).cast("int")).alias("kind"), "text",
        ((F.col("item_id") % 5 + 1) / 5).alias("confidence"), _day(F.col("item_id")).alias("created_at"), (F.col("item_id") % 11 == 0).alias("deleted"),
    )


def diaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select(F.col("conv_id").alias("id"), F.array_join(F.transform("t", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"), _day(F.col("conv_id")).alias("created_at"), (F.col("conv_id") % 13 == 0).alias("deleted"))


def retrieval_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target_type, id, path, source_role, text, updated_at, inactive) of sections, notes and diaries."""
    s = sections(spark, sf_dir).select("target_type", "id", "path", "source_role", "text", "updated_at", (F.col("deleted") | F.col("suppressed")).alias("inactive"))
    none = F.lit(None).cast("string")
    o = observations(spark, sf_dir).select(F.lit("memory").alias("target_type"), "id", none.alias("path"), none.alias("source_role"), "text", F.col("created_at").alias("updated_at"), F.col("deleted").alias("inactive"))
    d = diaries(spark, sf_dir).select(F.lit("diary").alias("target_type"), "id", none.alias("path"), none.alias("source_role"), "text", F.col("created_at").alias("updated_at"), F.col("deleted").alias("inactive"))
    return s.unionByName(o).unionByName(d)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, name, summary): regions, nations, customers and suppliers."""
    t = lambda name: table(spark, sf_dir, name)
    row = lambda kind, key, name, about: [F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"), about.alias("summary")]
    return (
        t("region").select(*row("region", "r_regionkey", "r_name", F.lit("region of nations")))
        .unionByName(t("nation").select(*row("nation", "n_nationkey", "n_name", F.lit("nation of customers"))))
        .unionByName(t("customer").select(*row("customer", "c_custkey", "c_name", F.col("c_mktsegment"))))
        .unionByName(t("supplier").select(*row("supplier", "s_suppkey", "s_name", F.lit("supplier"))))
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, subject_id, predicate, object_id, status, valid_from, valid_to, superseded_by, updated_at): the foreign keys of regions, nations, suppliers and customers."""
    t = lambda name: table(spark, sf_dir, name)
    since = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")

    def edge(df, kind, parent, parent_key, child, child_key):
        subject, target = (F.concat(F.lit(k + ":"), F.col(c).cast("string")) for k, c in ((parent, parent_key), (child, child_key)))
        status = F.when(F.col(child_key) % 10 == 7, "superseded").when(F.col(child_key) % 10 == 8, "invalidated").otherwise("active")
        return df.select(
            F.concat(F.lit(kind + "/"), F.col(child_key).cast("string")).alias("id"), subject.alias("subject_id"), F.lit("contains").alias("predicate"), target.alias("object_id"),
            status.alias("status"), since.alias("valid_from"), F.when(status != "active", _day(F.col(child_key) * 7)).alias("valid_to"),
            F.when(status == "superseded", F.lit("rel_earlier")).alias("superseded_by"), _day(F.col(child_key) * 3).alias("updated_at"),
        )

    return (
        edge(t("nation"), "rn", "region", "n_regionkey", "nation", "n_nationkey")
        .unionByName(edge(t("customer"), "nc", "nation", "c_nationkey", "customer", "c_custkey"))
        .unionByName(edge(t("supplier"), "ns", "nation", "s_nationkey", "supplier", "s_suppkey"))
    )
