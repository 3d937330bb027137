"""Ranked lexical search over impact-ordered postings, a score at a time.

A posting's impact is an integer of its own (from the occurrences of a term in a document and the document's length), a term's weight another; a document's score
is the sum of their products. Postings stay with their documents' files: a task reads rows into shards of bounded size, orders each term's postings
by impact, and takes a query's postings in descending order of weighted impact, group by group of equal impacts. Once what is left of all terms
together can't lift a document that it hasn't met to the k-th score, only the documents whose partial scores can still reach that score
count; theirs are completed from the documents' own lists. The tasks' short lists are merged by a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemodex.llm.common import cut, stored
from mnemodex.llm.terms import LETTERS_DIGITS, Terms, cut_terms, spread

#: Bytes of the queries' terms that texts are looked through for at once, and what a term takes besides its own.
TERM_BYTES, ROW_BYTES = 64_000_000, 64
#: Postings of a shard; of a step down in impact, the share of the impact that the next step begins at.
SHARD, STEP = 2_000_000, 0.7
#: An impact is less than this power of two.
BITS = 20


def _asked(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, hash, term, times): the different terms of each query."""
    texts = queries.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("item_id is not null and text is not null")
    texts = texts.groupBy("item_id").agg(F.max("text").alias("text"))

    def run(batches):
        for batch in batches:
            ids = batch.column("item_id").to_numpy()
            for first, terms in cut_terms(batch.column("text"), LETTERS_DIGITS):
                at = np.arange(len(terms.starts))
                owner = np.repeat(ids[first : first + len(terms.counts)], terms.counts)
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(terms.hashes.view(np.int64)), terms.strings(at).cast(pa.string())], names=["item_id", "hash", "term"])

    return texts.mapInArrow(run, "item_id long, hash long, term string").groupBy("item_id", "hash", "term").agg(F.count(F.lit(1)).alias("times"))


class Wanted:
    """The terms to look for: found by hash, then compared byte by byte."""

    def __init__(self, rows: list) -> None:
        rows = sorted(rows, key=lambda r: r.hash & (2**64 - 1))
        self.hashes = np.array([r.hash for r in rows], np.int64).view(np.uint64)
        self.numbers = np.array([r.number for r in rows], np.int64)
        words = [r.term.encode() for r in rows]
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.append(0, np.cumsum(self.lengths))[:-1]
        self.raw = np.frombuffer(b"".join(words), np.uint8)

    def find(self, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
        """(places among ``terms``, places among the wanted terms) of the terms that are wanted."""
        if not len(self.hashes) or not len(terms.hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found = np.minimum(np.searchsorted(self.hashes, terms.hashes), len(self.hashes) - 1)
        at = np.flatnonzero((self.hashes[found] == terms.hashes) & (self.lengths[found] == terms.lengths))
        found = found[at]
        own, offsets = spread(terms.starts[at], terms.lengths[at])
        theirs, _ = spread(self.starts[found], self.lengths[found])
        wrong = np.flatnonzero(terms.raw[own] != self.raw[theirs])
        if len(wrong):
            fine = np.ones(len(at), bool)
            fine[np.searchsorted(offsets, wrong, side="right") - 1] = False
            at, found = at[fine], found[fine]
        return at, found


def _postings(held):
    """Of each document its id, its number of terms, and which wanted terms it holds how often."""

    def run(batches):
        wanted = held.value
        for batch in batches:
            for first, terms in cut_terms(batch.column("text"), LETTERS_DIGITS):
                size = len(terms.counts)
                at, found = wanted.find(terms)
                owner = np.repeat(np.arange(size), terms.counts)[at]
                key, times = np.unique(owner * max(1, len(wanted.hashes)) + found, return_counts=True)
                owner, found = np.divmod(key, max(1, len(wanted.hashes)))
                ends = pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=size))), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (wanted.numbers[found], times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, size), pa.array(terms.counts), *lists], names=["doc_id", "n", "terms", "times"])

    return run


class Shard:
    """Postings of some documents, ordered by term and descending impact, and the documents' own lists."""

    def __init__(self, doc_ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int) -> None:
        self.doc_ids = doc_ids
        self.ends = np.append(0, np.cumsum(sizes))
        self.terms, self.impacts = terms, impacts
        owner = np.repeat(np.arange(len(doc_ids)), sizes)
        order = np.argsort(terms << BITS | ((1 << BITS) - 1 - impacts), kind="stable")
        self.docs, self.falling = owner[order], -impacts[order]
        self.bounds = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the ``k`` best of this shard's documents and of ``known`` (the best of earlier ones, in order); ties to the smaller id."""
        has = (self.bounds[terms] < self.bounds[terms + 1]) & (weights > 0)
        terms, weights = terms[has], weights[has]
        at, end = self.bounds[terms].copy(), self.bounds[terms + 1]
        if not len(terms):
            return known
        partial = np.zeros(len(self.doc_ids), np.int64)
        floor = int(known[1][-1]) if len(known[1]) == k else 0
        while True:
            left = np.flatnonzero(at < end)
            # What each term can add at most from here on; what no document that hasn't been met can pass.
            rest = -self.falling[at[left]] * weights[left]
            bound, cutoff = int(rest.sum()), floor
            if len(partial) > k:
                cutoff = max(cutoff, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
            if not len(left):
                near = np.flatnonzero(partial >= max(cutoff, 1))
                scores = partial[near]
                break
            if bound < cutoff:
                near = np.flatnonzero(partial + bound >= cutoff)
                if self.ends[near + 1].sum() - self.ends[near].sum() <= (end - at).sum():
                    scores = self._complete(near, terms, weights)
                    break
            # All groups down to a level, of each term those of the impacts that reach it with the term's weight.
            level = max(1, int(rest.max() * STEP))
            for t in left[rest >= level]:
                least = -(-level // int(weights[t]))
                stop = at[t] + int(np.searchsorted(self.falling[at[t] : end[t]], -least, side="right"))
                partial[self.docs[at[t] : stop]] -= self.falling[at[t] : stop] * weights[t]
                at[t] = stop
        ids, scores = np.append(known[0], self.doc_ids[near]), np.append(known[1], scores)
        order = np.lexsort((ids, -scores))[:k]
        order = order[scores[order] > 0]
        return ids[order], scores[order]

    def _complete(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores of some documents."""
        of_term = np.zeros(len(self.bounds), np.int64)
        of_term[terms] = weights
        places, offsets = spread(self.ends[docs], self.ends[docs + 1] - self.ends[docs])
        sums = np.append(0, np.cumsum(of_term[self.terms[places]] * self.impacts[places]))
        return sums[offsets[1:]] - sums[offsets[:-1]]


def _search(held, k: int):
    def run(batches):
        numbers, items = held.value
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items]
        waiting: list[tuple] = []

        def search() -> None:
            shard = Shard(*(np.concatenate(x) for x in zip(*waiting)), len(numbers))
            waiting.clear()
            for i, (_, terms, weights) in enumerate(items):
                best[i] = shard.best(terms, weights, k, best[i])

        for batch in batches:
            lists, times = batch.column("terms"), batch.column("times").flatten().to_numpy().astype(np.int64)
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            terms, m = lists.flatten().to_numpy(), np.repeat(batch.column("m").to_numpy(), sizes)
            found = np.minimum(np.searchsorted(numbers, terms), len(numbers) - 1)
            fine = numbers[found] == terms
            owner = np.repeat(np.arange(len(sizes)), sizes)[fine]
            times, m = times[fine], m[fine]
            waiting.append((batch.column("doc_id").to_numpy(), np.bincount(owner, minlength=len(sizes)), found[fine], 1_000_000_000 * times // (1000 * times + 12 * m)))
            if sum(len(x[2]) for x in waiting) >= SHARD:
                search()
        if waiting:
            search()
        for (item, _, _), (ids, scores) in zip(items, best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids), pa.array(scores)], names=["item_id", "doc_id", "score"])

    return run


def ranked(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each query, equal scores by ascending id.

    Terms are runs of letters, digits and all that isn't ASCII, A-Z lower-cased. With N documents that have a term, L terms in all, n of a document, df
    documents of a term and tf occurrences in a document: a term's weight is floor(1000 ln((2N + 2) / (2df + 1))), a document's m is
    75 + (25nN) div L, an impact is (1000000000 tf) div (1000 tf + 12m), and a score is the sum of weight times impact over a query's terms, repeats included.

    A null text has no terms. Documents and queries without an id take no part. Rows of documents that have the same id are documents of their
    own; queries of the same id are one, with its largest text. Documents of score 0 aren't found, so a query may have fewer than ``k`` rows or none.

    Queries are taken in blocks of ``TERM_BYTES`` of different terms (one block, but for very many queries): a block's terms are sent to the texts, the
    postings of these terms alone are written, and the block's queries are sent to them. Neither texts nor postings are shuffled; a task holds one shard.
    """
    spark = docs.sparkSession
    asked = cut(_asked(queries, item_col, item_text_col))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("term") + ROW_BYTES)).first()[0] or 0) // TERM_BYTES))
    out = None
    for block in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        found = _block(spark, mine, texts, k)
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(spark: SparkSession, asked: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, score): the best of each task for the queries of one block."""
    wanted = cut(asked.select("hash", "term").distinct().withColumn("number", F.monotonically_increasing_id()))
    held = spark.sparkContext.broadcast(Wanted(wanted.collect()))
    postings = stored(texts.mapInArrow(_postings(held), "doc_id long, n long, terms array<long>, times array<int>"))
    n_docs, n_terms = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    holders = postings.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = asked.join(wanted, ["hash", "term"]).join(holders, "number").select("item_id", "number", (weight * F.col("times")).alias("weight")).filter("weight > 0")
    rows: dict[int, list] = {}
    for r in weighted.collect():  # at most as many as the block's terms
        rows.setdefault(r.item_id, []).append((r.number, r.weight))
    numbers = np.array(sorted({number for of in rows.values() for number, _ in of}), np.int64)
    items = [(item, np.searchsorted(numbers, [number for number, _ in of]), np.array([w for _, w in of], np.int64)) for item, of in sorted(rows.items())]
    m = F.expr(f"75 + (25 * cast(n as decimal(20,0)) * {n_docs}) div {max(1, n_terms)}").cast("long")
    held = spark.sparkContext.broadcast((numbers, items))
    listed = postings.filter((F.size("terms") > 0) & F.lit(bool(items))).select("doc_id", m.alias("m"), "terms", "times")
    return listed.mapInArrow(_search(held, k), "item_id long, doc_id long, score long")
