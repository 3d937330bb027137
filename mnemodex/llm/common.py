"""Small pieces that the operators of this package share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names, which all executors share.

    Where the session names none, a temporary folder is made for a session on one machine; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="mnemodex-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as a checkpoint and go on from the written rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder as a compressed table, parted by some columns, and go on from the written rows."""
    place = f"{shared_folder(df.sparkSession).rstrip('/')}/mnemodex-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).option("compression", "zstd").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def released(run):
    """A task's function that gives memory back to the machine when it ends; Spark's Python workers live on and would keep what they once needed."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library than glibc
                pass

    return task


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """``crc32(doc_id as text) mod divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def bounded_share(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """About ``most`` of ``rows`` (all of them, if there are fewer), chosen by a hash of ``key``.

    A threshold on the hash needs one count and no sort, and picks the same rows
    whatever the partitioning is.
    """
    n = rows.count()
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1_000_003)) < int(1_000_003 * most / n))


def distinct_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, text_hash) of the rows that have both; rows with the same id and text are one."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    again = rows.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():  # the usual case; texts need no shuffle
        return rows
    again = cut(again)
    return rows.join(again, "doc_id", "left_anti").unionByName(rows.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text_hash"]))


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with as many ``_`` before it as tell it from ``columns``."""
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
