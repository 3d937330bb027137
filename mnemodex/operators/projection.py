"""What extraction derives from files: graph nodes, taxonomy, module rows, which files a run reads, embeddings."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemodex.functions import text


def entity_id(kind: str, name: Column) -> Column:
    return text.identifier("ent", F.concat(F.lit(f"{kind}:"), text.alias_form(name)))


def file_graph(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, name, path) and edges (id, subject_id, predicate, object_id) of sections (path, anchor, anchor_type).

    Each file is a node; each symbol is one, which its file defines.
    """
    files = sections.select("path").distinct().select(entity_id("file", F.col("path")).alias("id"), F.lit("file").alias("type"), F.col("path").alias("name"), "path")
    symbols = sections.filter("anchor_type = 'symbol'").select("path", "anchor").distinct()
    label = F.concat("path", F.lit("#"), "anchor")
    nodes = files.unionByName(symbols.select(entity_id("symbol", label).alias("id"), F.lit("symbol").alias("type"), F.col("anchor").alias("name"), "path"))
    ends = symbols.select(entity_id("file", F.col("path")).alias("subject_id"), F.lit("defines").alias("predicate"), entity_id("symbol", label).alias("object_id"))
    edges = ends.select(text.identifier("rel", F.col("subject_id"), F.col("predicate"), F.col("object_id")).alias("id"), "subject_id", "predicate", "object_id")
    return nodes, edges


def taxonomy(paths: DataFrame) -> DataFrame:
    """(node, parent, name, depth): every folder and file of the paths, once; top-level nodes have no parent."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("node"), n.alias("depth")))
    nodes = paths.select(F.explode(prefixes).alias("x")).select("x.node", "x.depth").distinct()
    parent = F.when(F.col("depth") > 1, F.regexp_replace("node", "/[^/]*$", ""))
    return nodes.select("node", parent.alias("parent"), F.substring_index("node", "/", -1).alias("name"), "depth")


def siblings(nodes: DataFrame) -> DataFrame:
    """(id, sibling): nodes (id, parent, name) of one parent, or of none, whose names are equal but for case."""
    a = nodes.select("id", "parent", F.lower("name").alias("name"))
    b = nodes.select(F.col("id").alias("sibling"), F.col("parent").alias("_parent"), F.lower("name").alias("_name"))
    return a.join(b, F.col("parent").eqNullSafe(F.col("_parent")) & (F.col("name") == F.col("_name")) & (F.col("id") != F.col("sibling"))).select("id", "sibling")


def links(paths: DataFrame) -> DataFrame:
    """(node, path): every file and the folders above it, once."""
    return taxonomy_of(paths).select("node", "path").distinct()


def taxonomy_of(paths: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    return paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("node"))


def plan_run(diff: DataFrame, mode: str) -> DataFrame:
    """(path, action): what a run does with each path of a snapshot diff: read, clear or keep.

    full and rebuild read all that is there; changed reads what was added or changed; resume reads what was never read. Deleted files are cleared.
    """
    reads = {"full": ["added", "changed", "unchanged"], "rebuild": ["added", "changed", "unchanged"], "changed": ["added", "changed"], "resume": ["added"]}[mode]
    return diff.select("path", F.when(F.col("change") == "deleted", "clear").when(F.col("change").isin(reads), "read").otherwise("keep").alias("action"))


def affected_modules(diff: DataFrame) -> DataFrame:
    """Top-level modules whose rows a changed run makes anew."""
    return diff.filter("change <> 'unchanged'").select(text.top_module(F.col("path")).alias("module_path")).distinct()


def section_line(kind: Column, path: Column, anchor: Column, content: Column) -> Column:
    first = F.substring(F.trim(F.element_at(F.split(F.regexp_replace(content, r"^\s+", ""), "\n"), 1)), 1, 120)
    return F.concat(kind, F.lit(" section from "), path, F.when(F.coalesce(anchor, F.lit("")) != "", F.concat(F.lit("#"), anchor)).otherwise(""), F.lit(": "), first)


def module_topics(path: Column) -> Column:
    return F.slice(F.filter(F.split(F.lower(path), "[/._-]+"), lambda w: F.length(w) > 2), 1, 8)


def stale(updated: Column, now: str, hours: float) -> Column:
    """True for missing dates, lifetimes of 0 or less, and anything older than its lifetime."""
    if hours <= 0:
        return F.lit(True)
    return F.coalesce((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(updated.cast("timestamp"))) / F.lit(3_600_000_000.0) > hours, F.lit(True))


def string_list(column: Column) -> Column:
    """A list of strings from JSON; what is malformed or no list is empty."""
    return F.coalesce(F.when(F.trim(column).startswith("["), F.from_json(column, "array<string>")), F.array().cast("array<string>"))


DIMENSIONS = 64


def _bucket(word: Column) -> Column:
    return F.conv(F.substring(F.md5(word), 1, 2), 16, 10).cast("int")


def hash_vectors(rows: DataFrame) -> DataFrame:
    """(id, bucket, value) of (id, text): a stand-in for a model. Words are hashed into ``DIMENSIONS`` signed buckets, a vector has length 1; only what is not 0 is listed.

    Counts are summed by (id, bucket), mostly before the shuffle.
    """
    d = rows.select("id", F.explode(F.transform(text.words(F.lower(F.coalesce("text", F.lit("")))), _bucket)).alias("d"))
    counted = d.groupBy("id", (F.col("d") % DIMENSIONS).alias("bucket")).agg(F.sum(F.when(F.col("d") >= 128, 1).otherwise(-1)).alias("n"))
    size = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("id")).cast("double"))
    return counted.select("id", "bucket", F.when(size > 0, F.col("n") / size).alias("value")).filter("value <> 0")


def hash_embedding(value: str, size: int = DIMENSIONS) -> list[float]:
    """The same vector of one text, for ``embed``."""
    out = np.zeros(size)
    for word in re.split(r"[ \t\n\x0b\f\r]+", value.lower()):
        if word:
            d = int(hashlib.md5(word.encode()).hexdigest()[:2], 16)
            out[d % size] += 1.0 if d >= 128 else -1.0
    length = np.sqrt((out * out).sum())
    return (out / length if length else out).astype(np.float32).tolist()


def embed(rows: DataFrame, embedder=hash_embedding, column: str = "text") -> DataFrame:
    """``rows`` with ``vector``, by any function from a text to a list of numbers, batch by batch."""

    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: embedder(v or ""))

    return rows.withColumn("vector", run(F.col(column)))


def embedding_work(docs: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """(id, state) of (id, text): needs_embedding, stale or fresh, by the hash of model and text that is stored with a vector."""
    now = F.sha2(F.concat(F.lit(model + ":"), "text"), 256)
    return docs.join(stored.select("id", F.col("hash").alias("_hash")), "id", "left").select("id", F.when(F.col("_hash").isNull(), "needs_embedding").when(F.col("_hash") != now, "stale").otherwise("fresh").alias("state"))


def reconcile(entries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(target_type, id, state): entries (target_type, id, hash) without a vector are missing, those whose vector is of another hash changed, vectors without an entry orphaned.

    One full outer join by key over the vectors of one group; texts take no part.
    """
    key = ["target_type", "id"]
    both = entries.select(*key, F.col("hash").alias("_due")).join(vectors.select(*key, F.col("hash").alias("_has")), key, "full_outer")
    state = F.when(F.col("_has").isNull(), "missing").when(F.col("_due").isNull(), "orphaned").when(F.col("_due") != F.col("_has"), "changed")
    return both.select(*key, state.alias("state")).filter("state is not null")
