"""How the sources of each language differ in the words they use: pairs of sources, and each source's most distinctive terms.

Words are counted where the texts are, and only (language, term) rows with the counts of their sources are shuffled, once. The most distinctive terms
of a group are found by radix selection: histograms over the bits of the values narrow each group's 50th value down, and ties there are narrowed
down by the bytes of the terms; no group is ever sorted whole. The distance of two sources is what two sources without any term would have, corrected at the terms that one
of them has; blocks of terms and tiles of sources keep a task's part bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemodex.llm.common import cut, partitions, stored
from mnemodex.llm.terms import LETTERS, Terms, cut_terms

#: (group, term) counts that a task gathers before it merges them, and passes them on if they are still more than half as many.
GATHERED = 1_500_000
#: Bits and bytes of a value or term that one histogram tells apart. Ties are sorted once they are so few in all.
BITS, BYTES, FEW = 10, 2, 200_000
#: Terms of a block and sources of a tile, of which a task compares two.
BLOCK_TERMS, TILE = 4_000, 256
#: Groups whose bounds are sent to all tasks; with more they are joined by a shuffle.
SENT_GROUPS = 100_000
#: Added to every count, and what shares are out of.
ADDED, SCALE = 5, 1_000_000_000


class _Counts:
    """Occurrences and documents of (group, term), gathered block by block."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple] = []

    def add(self, terms: Terms, group_of: np.ndarray) -> None:
        """The terms of some texts, each of a group; a term counts once for a text's documents."""
        if not len(terms.hashes):
            return
        known, first, term = np.unique(terms.hashes, return_index=True, return_inverse=True)
        owner = np.repeat(np.arange(len(terms.counts)), terms.counts)
        key, times = np.unique(owner * len(known) + term, return_counts=True)
        owner, term = np.divmod(key, len(known))
        self.parts.append(_summed(group_of[owner], known[term], terms.strings(first).take(pa.array(term)), times, np.ones(len(times), np.int64)))
        if sum(len(x[0]) for x in self.parts) > GATHERED:
            self._merge()

    def _merge(self) -> None:
        if len(self.parts) > 1:
            columns = list(zip(*self.parts))
            strings = pa.chunked_array(columns.pop(2)).combine_chunks()
            groups, hashes, times, texts = map(np.concatenate, columns)
            self.parts = [_summed(groups, hashes, strings, times, texts)]

    def large(self) -> bool:
        return len(self.parts) == 1 and len(self.parts[0][0]) > GATHERED // 2

    def rows(self):
        """A row for each language and term: documents, occurrences, and the occurrences of each source."""
        self._merge()
        if not self.parts:
            return
        groups, hashes, strings, times, texts = self.parts.pop()
        names = sorted(self.groups, key=self.groups.get)
        langs = sorted({lang for lang, _ in names})
        lang_of = np.array([langs.index(lang) for lang, _ in names])[groups]
        order = np.lexsort((hashes, lang_of))
        new = np.append(True, (np.diff(lang_of[order]) != 0) | (np.diff(hashes[order]) != 0))
        at = np.flatnonzero(new)
        source_names = pa.array([source for _, source in names], pa.string())
        for low in range(0, len(at), 50_000):
            part = at[low : low + 50_000]
            end = at[low + 50_000] if low + 50_000 < len(at) else len(order)
            rows = order[part[0] : end]
            starts = part - part[0]
            offsets = pa.array(np.append(starts, len(rows)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(langs, pa.string()).take(pa.array(lang_of[order[part]])), strings.take(pa.array(order[part])).cast(pa.string()), pa.array(np.add.reduceat(texts[rows], starts)),
                    pa.array(np.add.reduceat(times[rows], starts)), pa.ListArray.from_arrays(offsets, source_names.take(pa.array(groups[rows]))), pa.ListArray.from_arrays(offsets, pa.array(times[rows])),
                ],
                names=["lang", "term", "texts", "times", "sources", "counts"],
            )


def _summed(groups: np.ndarray, hashes: np.ndarray, strings: pa.Array, times: np.ndarray, texts: np.ndarray) -> tuple:
    """One row for each (group, hash), with sums."""
    order = np.lexsort((groups, hashes))
    g, h = groups[order], hashes[order]
    at = np.flatnonzero(np.append(True, (np.diff(h) != 0) | (np.diff(g) != 0)))
    return g[at], h[at], strings.take(pa.array(order[at])), np.add.reduceat(times[order], at), np.add.reduceat(texts[order], at)


def _count(batches):
    counts = _Counts()
    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        group_of = np.array([counts.groups.setdefault(x, len(counts.groups)) for x in zip(langs, sources)], np.int64)
        for first, terms in cut_terms(batch.column("text"), LETTERS):
            counts.add(terms, group_of[first : first + len(terms.counts)])
            if counts.large():
                yield from counts.rows()
    yield from counts.rows()


def _share(count: str, total: str, n_terms: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exact for counts of any size. Without terms the divisor is 1."""
    scaled = f"cast({count} + {ADDED} as decimal(20,0)) * {SCALE}"
    return F.expr(f"1 + ({scaled}) div cast(greatest({total} + {ADDED} * {n_terms}, 1) as decimal(20,0))").cast("long")


def _kept(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n): the occurrences of each kept term in the groups that have it, and in the language."""
    rows = docs.mapInArrow(_count, "lang string, term string, texts long, times long, sources array<string>, counts array<long>")
    of_term = Window.partitionBy("lang", "term")
    rows = rows.withColumns({"holders": F.sum("texts").over(of_term), "lang_n": F.sum("times").over(of_term)}).filter(F.col("holders") >= least_docs)
    rows = rows.select("lang", "term", "lang_n", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n"))))
    # The rows of a term lie together already, so this needs no further shuffle.
    return rows.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.first("lang_n").alias("lang_n"))


def _bound(rows: DataFrame, bounds: DataFrame, n_groups: int) -> DataFrame:
    """``rows`` with the bounds of their groups."""
    return rows.join(F.broadcast(bounds) if n_groups <= SENT_GROUPS else bounds, ["lang", "source"])


def _narrowed(rows: DataFrame, digit: Column, rising: bool, n_groups: int) -> tuple[DataFrame, DataFrame]:
    """One step of a radix selection: (rows that are surely among the wanted, rows that may be).

    ``rows`` have ``wanted``, the number of rows that their group wants of them. The histogram of ``digit`` shows the one in which the last of them lies; rows before
    it are wanted, and so are those in it if all are; else they go on with what is left.
    """
    rows = rows.withColumn("digit", digit)
    order = Window.partitionBy("lang", "source").orderBy(F.col("digit") if rising else F.desc("digit"))
    counted = rows.groupBy("lang", "source", "digit").agg(F.count(F.lit(1)).alias("here"), F.first("wanted").alias("wanted"))
    counted = counted.withColumn("before", F.sum("here").over(order) - F.col("here"))
    last = counted.filter((F.col("before") < F.col("wanted")) & (F.col("before") + F.col("here") >= F.col("wanted")))
    left = F.col("wanted") - F.col("before")
    last = last.select("lang", "source", F.col("digit").alias("last"), left.alias("left"), (left == F.col("here")).alias("whole"))
    met = _bound(rows, last, n_groups)
    ahead = F.col("digit") < F.col("last") if rising else F.col("digit") > F.col("last")
    inside = F.col("digit") == F.col("last")
    sure = met.filter(ahead | (inside & F.col("whole"))).drop("digit", "last", "left", "whole", "wanted")
    open_ = met.filter(inside & ~F.col("whole")).drop("digit", "last", "whole", "wanted").withColumnRenamed("left", "wanted")
    return sure, open_


def top_terms(rows: DataFrame, k: int, n_groups: int) -> DataFrame:
    """The ``k`` rows (all, if fewer) of the highest ``value`` of each (lang, source), equal ones by their term's UTF-8 bytes, with their rank.

    ``rows`` (lang, source, term, value) should be cheap to read again: each step does. Values are not negative, terms of a group differ.
    """
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    sizes = cut(rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most")))
    most = sizes.agg(F.max("most")).first()[0]
    few = _bound(rows, sizes.filter(F.col("n") <= k).select("lang", "source"), n_groups)
    wanted = [few]
    open_ = _bound(rows, sizes.filter(F.col("n") > k).select("lang", "source", F.lit(k).cast("long").alias("wanted")), n_groups)
    for shift in range((max(1, int(most or 0).bit_length()) - 1) // BITS * BITS, -1, -BITS):
        sure, open_ = _narrowed(open_, F.shiftright("value", shift).bitwiseAND(F.lit((1 << BITS) - 1)), False, n_groups)
        open_ = stored(open_)
        wanted.append(sure)
    # What is left of a group has one value.
    at = 0
    while open_.count() > FEW:
        piece = F.substring(F.encode("term", "utf-8"), BYTES * at + 1, BYTES)
        sure, open_ = _narrowed(open_, piece, True, n_groups)
        open_ = stored(open_)
        wanted.append(sure)
        at += 1
    wanted.append(open_.drop("wanted"))
    found = wanted[0]
    for part in wanted[1:]:
        found = found.unionByName(part)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _compare(key: tuple, table: pa.Table) -> pa.Table:
    """Sums over a block's terms of |p - q| less what the baselines differ by, for the pairs of two tiles' sources.

    For a source a with terms A, and b with terms B: over A the sum of |p - q| - |base - q|, where q is b's share or baseline; over B the sum of
    |base - q| - |base - q's baseline|. Only terms that a source has are visited.
    """
    lang, _, left, right = (x.as_py() for x in key)
    bare = pa.compute.is_null(table.column("term"))
    sources, has = table.filter(bare), table.filter(pa.compute.invert(bare))
    ids, tiles, base = (sources.column(c).to_numpy() for c in ("id", "tile", "share"))
    order = np.lexsort((ids, tiles))
    ids, tiles, base = ids[order], tiles[order], base[order]
    terms = has.column("term").combine_chunks().dictionary_encode()
    column, row = terms.indices.to_numpy(), np.searchsorted(ids, has.column("id").to_numpy())
    share = has.column("share").to_numpy()
    x = np.repeat(base[:, None], max(1, len(terms.dictionary)), axis=1)
    x[row, column] = share
    by_source = np.argsort(row, kind="stable")
    ends = np.searchsorted(row[by_source], np.arange(len(ids) + 1))
    out: list[tuple] = []
    own = {i: column[by_source[ends[i] : ends[i + 1]]] for i in range(len(ids))}
    for a in np.flatnonzero(tiles == left):
        others = np.flatnonzero(tiles == right) if left != right else np.arange(a + 1, len(ids))
        if not len(others):
            continue
        theirs, mine = x[np.ix_(others, own[a])], x[a, own[a]]
        sums = (np.abs(theirs - mine) - np.abs(theirs - base[a])).sum(axis=1)
        for i, b in enumerate(others):
            q = x[b, own[b]]
            sums[i] += (np.abs(q - base[a]) - abs(int(base[b]) - int(base[a]))).sum()
        out.append((np.full(len(others), ids[a]), ids[others], sums))
    a, b, sums = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 3
    return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(sums)], names=["lang", "a", "b", "value"])


def _pairs(kept: DataFrame, groups: DataFrame, blocks: int) -> DataFrame:
    """(lang, a, b, value): the distance of each two sources of a language, by their numbers, once."""
    tiles = groups.groupBy("lang").agg(F.max("tile").alias("last"))
    schema = "lang string, a long, b long, value long"
    spread = groups.join(tiles, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    pair = (F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"))
    bare = spread.select("lang", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), *pair, "id", "tile", F.lit(None).cast("string").alias("term"), F.col("base").alias("share"))
    has = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), "last")).alias("other"), "id", "tile", "term", "share")
    has = has.select("lang", "block", *pair, "id", "tile", "term", "share")
    sums = bare.unionByName(has).groupBy("lang", "block", "left", "right").applyInArrow(_compare, schema)
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, k: int = 50, least_docs: int = 30, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) of ``docs``.

    Terms are runs of letters and of all that isn't ASCII, A-Z lower-cased; a language keeps those in at least ``least_docs`` of its documents. A
    group's share of a kept term is 1 + floor(10^9 (count + 5) / (N + 5V)), with N its occurrences of all V kept terms; a language's share likewise.

    Part ``pair``: each other source of the language, with the sum over kept terms of how far the two shares lie apart (0 without kept terms). Part ``term``:
    the ``k`` kept terms that the group has and whose share is furthest above the language's. Ranks go by falling value, then by the item's UTF-8 bytes.

    Null texts, languages and sources are "". Groups without kept terms are in part ``pair`` too; a language's only source has no pairs. Repeated rows count
    as often as they occur; other columns are ignored. Terms of one task that share a 64-bit hash count as one.
    """
    spark = docs.sparkSession
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    kept = stored(_kept(docs, least_docs))
    known = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_distinct("term").alias("n_terms"))
    groups = docs.select("lang", "source").distinct().join(known, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "n_terms"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.withColumn("id", number.cast("long")).withColumn("tile", F.floor(F.col("id") / TILE).cast("int"))
    groups = cut(groups.withColumn("base", _share("0", "total", "n_terms")))
    n_groups, n_terms = groups.agg(F.count(F.lit(1)), F.max("n_terms")).first()
    last = groups.groupBy("lang").agg(F.max("tile").alias("last"))
    facts = groups.join(last, "lang").select("lang", "source", "total", "lang_total", "n_terms", "id", "tile", "last")
    shares = _bound(kept, facts, n_groups).withColumns({"share": _share("n", "total", "n_terms"), "lang_share": _share("lang_n", "lang_total", "n_terms")})

    above = stored(shares.filter(F.col("share") > F.col("lang_share")).select("lang", "source", "term", (F.col("share") - F.col("lang_share")).alias("value")))
    terms = top_terms(above, k, n_groups).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    sums = _pairs(shares, groups, max(partitions(spark), -(-(n_terms or 0) // BLOCK_TERMS)))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    one = groups.select("lang", F.col("id").alias("a"), "source", F.col("base").alias("base_a"), "n_terms")
    other = groups.select("lang", F.col("id").alias("b"), F.col("source").alias("item"), F.col("base").alias("base_b"))
    pairs = both.join(one, ["lang", "a"]).join(other, ["lang", "b"])
    pairs = pairs.withColumn("value", F.col("value") + F.col("n_terms") * F.abs(F.col("base_a") - F.col("base_b")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank).unionByName(terms)
