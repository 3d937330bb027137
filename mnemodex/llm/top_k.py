"""Exact top-k search by inner product, with MaxScore pruning inside shards.

A vector is a document whose terms are its dimensions; a query's terms are its
own components. Candidates stay where they are: queries are sent to them in blocks of bounded size, and each task
cuts its rows into shards, keeps each shard's postings (of every term its rows' values), and carries the queries' best
rows from shard to shard, so that later ones are pruned more. The tasks' short lists are merged by a
window. No pair of rows leaves a task unless it is in the task's top k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemodex.llm.common import cut, stored
from mnemodex.llm.vectors import matrix, usable

#: Bytes of the queries that are sent at once, and rows of a shard.
QUERY_BYTES, SHARD = 16_000_000, 16_384
#: Candidates whose essential terms are traversed at once, and terms probed between two cuts.
CHUNK, STEP = 4096, 8


def quantised(vector, scale: int = 256):
    """floor(scale * x) of each component, with x as double."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))


def _exact(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Inner products without rounding: by floating-point multiplication where no sum can pass 2**53."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(weights).max(initial=0)) * max(1, len(weights))
    return (rows.astype(np.float64) @ weights.astype(np.float64)).astype(np.int64) if most < 2.0**53 else rows @ weights


class Shard:
    """Candidates by term: the values of a term's posting list, in the order of the ids, and what they are at most and least."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        self.postings = np.ascontiguousarray(rows.T)
        self.most, self.least = rows.max(axis=0), rows.min(axis=0)
        # Sums of products stay exact in double precision up to 2**53.
        self.wide = self.postings.astype(np.float64) if float(np.abs(rows).max(initial=0)) ** 2 * rows.shape[1] < 2.0**52 else None


def maxscore(queries: np.ndarray, query_ids: np.ndarray, shard: Shard, k: int, best: list[tuple[np.ndarray, np.ndarray]] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each query the (ids, scores) of its ``k`` best rows, of the shard and of ``best`` (those of earlier shards); ties to the smaller id, never the query's own id.

    A term's bound is what it can add at most above what it adds at least, over all rows
    here. Terms are split by bound: those of the largest bounds are essential, and the
    others, whose bounds together can't lift a row over the k-th score so far, are not.
    The postings of essential terms are traversed for a chunk of rows; others are probed for the rows whose
    score and the bounds of the terms that were not probed yet reach the k-th score.
    """
    out, ids = [], shard.ids
    for n, (q, own) in enumerate(zip(queries, query_ids)):
        best_id, best_score = best[n] if best else (np.empty(0, np.int64), np.empty(0, np.int64))
        high, low = np.maximum(q * shard.most, q * shard.least), np.minimum(q * shard.most, q * shard.least)
        order = np.argsort(low - high, kind="stable")
        # rest[i]: what the terms from i on, in order, can add at most.
        rest = np.append(np.cumsum(high[order][::-1])[::-1], 0)
        floor = np.append(0, np.cumsum(low[order]))
        for start in range(0, len(ids), CHUNK):
            at = np.arange(start, min(start + CHUNK, len(ids)))
            kth = best_score[-1] if len(best_score) == k else None
            cutoff = len(order)
            if kth is not None and (floor + rest < kth).any():
                # Even a row that gets the least from the first ``cutoff`` terms is out of reach: the others are non-essential.
                cutoff = min(len(order), max(STEP, int(np.argmax(floor + rest < kth))))
            part = order[:cutoff]
            if shard.wide is not None and abs(q).max(initial=0) < 2**20:
                score = (q[part].astype(np.float64) @ shard.wide[part, start : at[-1] + 1]).astype(np.int64)
            else:
                score = _exact(shard.postings[part, start : at[-1] + 1].T, q[part])
            done = cutoff
            while kth is not None:
                fine = score + rest[done] >= kth
                at, score = at[fine], score[fine]
                if done == len(order) or not len(at):
                    break
                part = order[done : done + STEP]
                score = score + _exact(shard.rows[np.ix_(at, part)], q[part])
                done += len(part)
            if len(at):
                other = ids[at] != own
                score, found = np.append(best_score, score[other]), np.append(best_id, ids[at][other])
                top = np.lexsort((found, -score))[:k]
                best_score, best_id = score[top], found[top]
        out.append((best_id, best_score))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products.

    Components become floor(scale * x). Rows whose id is null, or whose vector is null, empty or holds
    null or non-finite components, take no part, neither as query nor as candidate. A
    query meets only vectors of its own length. Ties go to the smaller id; a query's own id is never
    among its results, and an id that occurs several times counts as several candidates
    of that id (as a query it counts once, with the largest vector in Spark's order). Fewer than ``k`` candidates give fewer rows.
    """
    def side(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
        return df.select("id", quantised(F.col("v"), scale).alias("v"), F.size("v").alias("dim"))

    spark, c = vectors.sparkSession, side(vectors)
    q = cut(side(queries).groupBy("id").agg(F.max(F.struct("v", "dim")).alias("x")).select("id", "x.*"))
    blocks = max(1, -(-(q.agg(F.sum("dim")).first()[0] or 0) * 8 // QUERY_BYTES))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = None
    for block in range(blocks):
        asked: dict[int, tuple[list, list]] = {}
        for row in q.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect():  # about QUERY_BYTES, whatever the number of queries
            ids, rows = asked.setdefault(row.dim, ([], []))
            ids.append(row.id)
            rows.append(row.v)
        held = spark.sparkContext.broadcast({dim: (np.array(ids), np.array(rows)) for dim, (ids, rows) in asked.items()})
        short = c.filter(F.col("dim").isin(list(asked))).select("id", "v", "dim").mapInArrow(_search(held, k), "query_id long, vec_id long, score long")
        if blocks > 1:
            short = stored(short.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank"))
        found = short if found is None else found.unionByName(short)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(held, k: int):
    def run(batches):
        queries = held.value
        best: dict[int, list] = {}
        waiting: dict[int, list] = {dim: [] for dim in queries}

        def search(dim: int) -> None:
            rows, ids = (np.concatenate(x) for x in zip(*waiting[dim]))
            waiting[dim] = []
            best[dim] = maxscore(queries[dim][1], queries[dim][0], Shard(rows, ids), k, best.get(dim))

        for batch in batches:
            of = batch.column("dim").to_numpy()
            for dim in np.unique(of).tolist():
                part = batch.filter(pa.array(of == dim)) if (of != dim).any() else batch
                rows, ids = matrix(part.column("v")), part.column("id").to_numpy()
                for at in range(0, len(ids), SHARD):
                    waiting[dim].append((rows[at : at + SHARD], ids[at : at + SHARD]))
                    if sum(len(x[1]) for x in waiting[dim]) >= SHARD:
                        search(dim)
        for dim in [d for d, rows in waiting.items() if rows]:
            search(dim)
        for dim, lists in best.items():
            ids = np.repeat(queries[dim][0], [len(i) for i, _ in lists])
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(np.concatenate([x[i] for x in lists]).astype(np.int64)) for i in (0, 1))], names=["query_id", "vec_id", "score"])

    return run
