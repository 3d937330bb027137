"""A text index: postings by term, and what is indexed. Search reads its terms' postings and no text.

``postings`` has (bucket, term, target_type, id, tf, size), a row for each term of a document; ``bucket`` is a hash of the term
by which the table can be parted, so that a search reads few files. ``indexed`` has (target_type, id, text_hash, size), a row for each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemodex.operators import search
from mnemodex.operators.relational import without

BUCKETS = 64
KEY = ["target_type", "id"]


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(docs: DataFrame) -> DataFrame:
    """The postings of ``docs`` (target_type, id, text). Words are counted in the row: sorted, they are runs of equal words."""
    once = F.transform(F.array(F.array_sort(search.index_tokens(F.coalesce("text", F.lit(""))))), lambda t: F.struct(t.alias("t")))
    rows = docs.select(*KEY, F.inline(once)).filter(F.size("t") > 0)
    starts = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.element_at("t", i) != F.element_at("t", F.greatest(i - 1, F.lit(1)))))
    rows = rows.select(*KEY, "t", starts.alias("s"))
    ends = F.concat(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.array(F.size("t") + 1))
    runs = F.zip_with("s", ends, lambda a, b: F.struct(F.element_at("t", a).alias("term"), (b - a).alias("tf")))
    rows = rows.select(*KEY, F.size("t").alias("size"), F.inline(runs))
    return rows.select(bucket(F.col("term")).alias("bucket"), "term", *KEY, "tf", "size")


def indexed(docs: DataFrame) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    return docs.select(*KEY, F.sha2(body, 256).alias("text_hash"), F.size(search.index_tokens(body)).alias("size"))


def outdated(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(target_type, id, state): documents that are missing in the index or changed since, and indexed ones that are gone."""
    now = docs.select(*KEY, F.sha2(F.coalesce("text", F.lit("")), 256).alias("_now"))
    both = now.join(known.select(*KEY, F.col("text_hash").alias("_was")), KEY, "full_outer")
    state = F.when(F.col("_was").isNull(), "missing").when(F.col("_now").isNull(), "gone").when(F.col("_now") != F.col("_was"), "changed")
    return both.select(*KEY, state.alias("state")).filter("state is not null")


def refresh(docs: DataFrame, old_postings: DataFrame, old_indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings and list of an index brought up to date with ``docs``; only missing and changed documents are tokenised."""
    work = outdated(docs, old_indexed)
    new = docs.join(work.filter("state <> 'gone'").select(*KEY), KEY, "left_semi")
    known = without(old_indexed, work, KEY)
    return without(old_postings, work, KEY).select(old_postings.columns).unionByName(postings(new)), known.select(old_indexed.columns).unionByName(indexed(new))


def _hits(found: DataFrame, wanted: list[str]) -> DataFrame:
    buckets = found.sparkSession.createDataFrame([(w,) for w in wanted], "t string").select(bucket(F.col("t")).alias("b"))
    return found.filter(F.col("bucket").isin(sorted({r.b for r in buckets.collect()})) & F.col("term").isin(wanted))


def _ranks(hits: DataFrame, total: int, mean: float | None, wanted: list[str]) -> DataFrame:
    held = {r.term: r["count"] for r in hits.groupBy("term").count().collect()}  # a row for each term of the query
    rank = F.lit(0.0)
    for term in wanted:
        n = held.get(term, 0)
        idf = F.greatest(F.lit(1e-6), F.log(F.lit((total - n + 0.5) / (n + 0.5))))
        f = F.coalesce(F.sum(F.when(F.col("term") == term, F.col("tf"))), F.lit(0)).cast("double")
        rank = rank + idf * f * (search.K1 + 1) / (f + search.K1 * (1 - search.B + search.B * F.first("size") / F.lit(mean or 1.0)))
    return hits.groupBy(*KEY).agg(rank.alias("rank"))


def bm25(found: DataFrame, known: DataFrame, wanted: list[str]) -> DataFrame:
    """(target_type, id, rank) of the documents that hold one of the terms, by the same ranks as ``search.bm25``.

    One scan of the list gives the statistics (one row), one of the terms' postings the number of documents that hold each.
    """
    total, mean = known.agg(F.count(F.lit(1)), F.avg("size")).first()
    if not total:
        return known.select(*KEY, F.lit(0.0).alias("rank")).limit(0)
    return _ranks(_hits(found, wanted), total, mean, wanted)

# Segments ---------------------------------------------------------------------------------------
#
# A segment holds the postings and the list of some documents, and never changes. A document that changes or goes gets a tombstone (segment, target_type, id, size) in
# its segment and, if it has a new text, goes to a new segment; so work follows what has changed. Segments of like size are merged, and their tombstones go with them.

#: So many segments of one size class are merged.
FANOUT = 4


def live(listed: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of a list or of postings, with their ``segment``, that no tombstone hits."""
    return listed.join(gone.select("segment", *KEY), ["segment", *KEY], "left_anti")


def tombstones(listed: DataFrame, gone: DataFrame, keys: DataFrame) -> DataFrame:
    """(segment, target_type, id, size): new tombstones for the documents ``keys``; what has one already, or isn't indexed, gets none."""
    return live(listed, gone).join(keys.select(*KEY).distinct(), KEY, "left_semi").select("segment", *KEY, "size")


def statistics(listed: DataFrame, gone: DataFrame) -> DataFrame:
    """(segment, docs, size): documents that live in each segment, and their words. A segment without any has a row of zeros."""
    both = listed.select("segment", F.lit(1).alias("n"), "size").unionByName(gone.select("segment", F.lit(-1).alias("n"), (-F.col("size")).alias("size")))
    return both.groupBy("segment").agg(F.sum("n").alias("docs"), F.sum("size").alias("size"))


def to_merge(sizes: dict[str, int], fanout: int = FANOUT) -> list[str]:
    """Segments to merge next: those of the smallest class that has ``fanout`` of them. A class holds sizes from a power of ``fanout`` up to the next."""
    classes: dict[int, list[str]] = {}
    for name, n in sizes.items():
        at = 0
        while n >= fanout ** (at + 1):
            at += 1
        classes.setdefault(at, []).append(name)
    return next((sorted(names) for _, names in sorted(classes.items()) if len(names) >= fanout), [])


def merged(rows: DataFrame, gone: DataFrame, names: list[str], name: str) -> DataFrame:
    """The rows of the segments ``names`` that still live, as those of one segment; for postings and lists alike. No text is read."""
    return live(rows.filter(F.col("segment").isin(names)), gone).withColumn("segment", F.lit(name))


def bm25_segments(found: DataFrame, gone: DataFrame, docs: int, size: int, wanted: list[str]) -> DataFrame:
    """(target_type, id, rank) as by ``bm25`` over the live documents, ``docs`` of them with ``size`` words (the sums of ``statistics``, a row for each segment).

    Only the postings of the query's terms are read, and only they meet the tombstones.
    """
    return _ranks(live(_hits(found, wanted), gone), docs, size / docs if docs else 0.0, wanted)
