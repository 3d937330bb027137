"""Near duplicates by SimHash: fingerprints, and their exact join within a Hamming radius.

Fingerprints are compared in blocks. The bit planes of a block are stored
vertically (plane j holds bit j of all its fingerprints, 64 to a word), and for
every fingerprint the distances to the whole block are counted together by a
carry-save bitwise counter, plane after plane, until each distance of the
block has passed the radius.

For links by distance alone, which blocks there are follows from the pigeonhole principle: the 64 bits are cut into
bands, and two fingerprints at distance r or less agree in all but r of them. Rows
are dealt by the bands that agree, so a block holds rows of neighbouring buckets. For links by the similarity of
shingle sets, whose fingerprints can be far apart, rows are dealt by minima of their shingles' hashes, and the pairs
that the comparison leaves are checked exactly.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from mnemodex.llm.common import cut, distinct_texts, fresh, partitions, released
from mnemodex.llm.components import connected_components
from mnemodex.llm.url_filter import possible_hits
from mnemodex.llm.words import hashed_words, mixed

SHINGLE, SEED = 3, 42
#: Fingerprints compared with each other at once, and the rows of a bucket from which it is cut into parts.
BLOCK, HOT_BUCKET = 1024, 4096
#: Shingles beyond which a bucket's texts are compared in parts.
HOT_SIZE = 8_000_000
#: More bands, and so longer keys, once a bucket would hold more than so many rows.
ROWS_A_BUCKET = 256


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of the text's word shingles; A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if len(words) > size:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
        return np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - size + 1)
    return np.array([xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit j is 1 if it is set in over half the hashes; zero without hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column("text")
        out = np.fromiter((fingerprint(shingle_hashes(texts[i].as_py())) for i in range(len(texts))), np.int64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit number. Null texts count as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def links_within(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of the fingerprints in one block that differ in at most ``radius`` (0 to 63) bits."""
    n = len(fps)
    words = -(-n // 64)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((words * 64, 64), np.uint8)
    padded[:n] = bits
    planes = np.packbits(np.ascontiguousarray(padded.T), axis=1, bitorder="little").view(np.uint64)  # plane j: bit j of every fingerprint
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    asked = np.arange(n)
    over = np.zeros((n, words), np.uint64)
    counter = [np.zeros((n, words), np.uint64) for _ in range(radius.bit_length())]  # digit k of all distances

    def past() -> np.ndarray:
        """Bits of the distances that exceed the radius."""
        more, equal = over, ~over
        for k in reversed(range(len(counter))):
            if radius >> k & 1:
                equal = equal & counter[k]
            else:
                more, equal = more | (equal & counter[k]), equal & ~counter[k]
        return more

    for j in range(64):
        carry = planes[j][None, :] ^ (np.where(bits[asked, j], full, np.uint64(0)))[:, None]
        for k, digit in enumerate(counter):
            counter[k], carry = digit ^ carry, digit & carry
        over = over | carry
        if j >= 4 * radius and j % 4 == 0:  # rows whose whole block is out of reach are abandoned
            live = (past() != full).any(axis=1)
            if not live.all():
                asked, over, counter = asked[live], over[live], [c[live] for c in counter]
                if not len(asked):
                    return np.empty(0, np.int64), np.empty(0, np.int64)
    near = np.unpackbits(np.ascontiguousarray(~past()).view(np.uint8), axis=1, bitorder="little")[:, :n]
    i, j = np.nonzero(near)
    i = asked[i]
    return i[i < j], j[i < j]


def _forest(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links as (fingerprint, root) edges of their local components: no more edges than fingerprints."""
    label = np.arange(len(fps))
    while len(i):
        small = np.minimum(label[i], label[j])
        if (label[i] == small).all() and (label[j] == small).all():
            break
        np.minimum.at(label, label[i], small)
        np.minimum.at(label, label[j], small)
        while (label != label[label]).any():
            label = label[label]
    moved = label != np.arange(len(fps))
    return fps[moved], fps[label[moved]]


def _compare(radius: int):
    """Rows sorted by (band, key, part) become edges; whole buckets are put together to blocks."""

    def block(fps: list[np.ndarray]):
        fps = np.unique(np.concatenate(fps))
        out = [(np.empty(0, np.int64),) * 2]
        for a in range(0, len(fps), BLOCK):
            for b in range(a, len(fps), BLOCK):
                both = fps[a : a + BLOCK] if a == b else np.concatenate([fps[a : a + BLOCK], fps[b : b + BLOCK]])
                out.append(_forest(both, *links_within(both, radius)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b"])

    def run(batches):
        held: list[np.ndarray] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, fps = batch.column("bucket").to_numpy(), batch.column("fp").to_numpy()
            starts = np.append(0, np.nonzero(bucket[1:] != bucket[:-1])[0] + 1)
            for s, e in zip(starts, np.append(starts[1:], len(fps))):
                if bucket[s] != last and size >= BLOCK // 2:
                    yield block(held)
                    held, size = [], 0
                held.append(fps[s:e])
                size, last = size + e - s, bucket[s]
        if held:
            yield block(held)

    return run


def fingerprint_edges(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) between the different values of ``fp`` that connect all within ``radius`` bits of each other.

    The edges have the same components as all links, but not every link is among them.
    """
    fps = cut(fps.select("fp").distinct())
    n = fps.count()
    bands = radius + 1
    while n > ROWS_A_BUCKET << (64 * (bands - radius) // bands) and bands < 8:
        bands += 1
    bounds = [64 * k // bands for k in range(bands + 1)]
    keys = []
    for t, chosen in enumerate(combinations(range(bands), bands - radius)):
        mask = sum(((1 << (bounds[k + 1] - bounds[k])) - 1) << bounds[k] for k in chosen)
        mask -= (1 << 64) * (mask >> 63)
        keys.append(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(mask).cast("long"))))
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    return _dealt(rows, "fp").mapInArrow(_compare(radius), "a long, b long")


def _parted(rows: DataFrame, by: str, size: str | None = None) -> DataFrame:
    """``rows``, with buckets that hold very many rows, or very large ones by ``size``, replaced by one bucket for each pair of their parts.

    A part has half of what a bucket may hold, so a pair of parts is as large as a bucket that is left whole (but for single rows that are larger).
    """
    count, load = F.count(F.lit(1)).alias("count"), (F.sum(size) if size else F.lit(0)).cast("long").alias("load")
    hot = rows.groupBy("bucket").agg(count, load).filter((F.col("count") > HOT_BUCKET) | (F.col("load") > HOT_SIZE))
    if hot.isEmpty():
        return rows
    columns = rows.columns
    need = F.greatest(F.ceil(F.col("count") / (HOT_BUCKET // 2)), F.ceil(F.col("load") / (HOT_SIZE // 2)))
    parts = F.least(F.coalesce(need, F.lit(1)), F.coalesce("count", F.lit(1))).cast("int")
    rows = rows.join(cut(hot), "bucket", "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64(by, F.lit(11)), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))
    return rows.withColumn("bucket", F.when(F.col("parts") == 1, F.col("bucket")).otherwise(pair)).select(*columns)


def _gathered(rows: DataFrame) -> DataFrame:
    """``rows`` with the rows of a ``bucket`` together."""
    return rows.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket")


def _dealt(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with the rows of a ``bucket`` together. A bucket that holds very many is compared part by part: each pair of parts is a bucket of its own."""
    return _gathered(_parted(rows, by))


def near_duplicates(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``.

    Documents link if their fingerprints differ in at most ``radius`` (0 to 3) bits.
    ``fingerprint`` has 16 lower-case hexadecimal digits; a text without words, or null, has
    fingerprint zero and links like any other. ``component_id`` is the smallest doc_id that can be
    reached, the document's own included. Rows with a null id take part, but name no component: theirs is the
    smallest id reached, or null. Repeated rows stay repeated. Equal fingerprints are
    compared once, so groups of copies of any size cost no more than one text.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    components = connected_components(fingerprint_edges(fps, radius))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = _named(least.withColumnRenamed("fp", "node"), components).withColumnRenamed("node", "fp")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _named(least: DataFrame, components: DataFrame) -> DataFrame:
    """(node, component_id): of all nodes of (node, least), the smallest ``least`` of their component. A component may hold any share of the nodes."""
    joined = cut(least.join(components, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")))
    return cut(joined.join(cut(joined.groupBy("component").agg(F.min("least").alias("component_id"))), "component").select("node", "component_id"))


# Links by similarity.

#: Keys of a document, each made of so many minima: at a similarity of 0.8 a pair shares a key in 99.8 of 100 cases.
BANDS, MINIMA = 16, 5
#: Pairs whose fingerprints differ in more bits are not checked further: at a similarity of 0.8 they differ in 10, with a deviation of 3.
FAR = 20
#: Texts whose pairs are checked against each other at once; nearly all of them may be pairs.
CHECKED = 256

_FACTORS = np.random.default_rng(41).integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingles(h: np.ndarray, sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number for each text) of the ``size``-word shingles of texts whose words' hashes are ``h``; a shorter text is one shingle, one without words has none."""
    n, ends = len(h), np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = ends[owner] - np.arange(n)  # words from here to the text's end
    out = np.zeros(n, np.uint64)
    for i in range(size):
        word = np.append(h[i:], np.zeros(min(i, n), np.uint64))
        out = np.where(left > i, (out ^ (out >> np.uint64(29)) ^ word) * np.uint64(0xBF58476D1CE4E5B9), out)
    begins = (left >= size) | ((sizes[owner] < size) & (left == sizes[owner]))
    return mixed(out[begins]), np.where(sizes >= size, sizes - size + 1, np.minimum(sizes, 1))


def _sketches(size: int):
    names = ["doc_id", "h", "g", "fp", "n", *(f"k{i}" for i in range(BANDS))]

    def run(batches):
        for batch in batches:
            for first, h, sizes in hashed_words(batch.column("text")):
                x, counts = _shingles(h, sizes, size)
                ids, full = batch.column("doc_id").slice(first, len(sizes)), counts > 0
                # What the words are, in order: two hashes of each text.
                place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                starts, at = (np.cumsum(sizes) - sizes)[full], (np.cumsum(counts) - counts)[full]
                out = np.zeros((4 + BANDS, len(sizes)), np.uint64)
                out[3] = counts
                if len(at):
                    for row, factor in ((0, 0x9E3779B97F4A7C15), (1, 0xD6E8FEB86659FD93)):
                        out[row, full] = np.add.reduceat(mixed(h ^ (place.astype(np.uint64) + np.uint64(1)) * np.uint64(factor)), starts)
                    bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
                    out[2, full] = np.packbits(2 * ones > counts[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
                    for band in range(BANDS):
                        key = np.full(len(at), np.uint64(band))
                        for factor in _FACTORS[band * MINIMA : (band + 1) * MINIMA]:
                            key = mixed(key ^ np.minimum.reduceat(x * factor, at))
                        out[4 + band, full] = key
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c.view(np.int64)) for c in out)], names=names)

    return run, ", ".join(f"{c} long" for c in names)


def _sets(size: int):
    """(doc_id, h, shingles): the different shingles of a text, as 32-bit hashes."""

    def run(batches):
        for batch in batches:
            for first, h, sizes in hashed_words(batch.column("text")):
                x, counts = _shingles(h, sizes, size)
                owner = np.repeat(np.arange(len(sizes)), counts)
                x = x.astype(np.uint32).view(np.int32)
                by = np.lexsort((x, owner))
                x, owner = x[by], owner[by]
                new = np.append(True, (x[1:] != x[:-1]) | (owner[1:] != owner[:-1]))[: len(x)]
                offsets = np.append(0, np.cumsum(np.bincount(owner[new], minlength=len(sizes)))).astype(np.int32)
                place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                named, full = np.zeros(len(sizes), np.uint64), sizes > 0
                if full.any():
                    named[full] = np.add.reduceat(mixed(h ^ (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), (np.cumsum(sizes) - sizes)[full])
                shingles = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[new]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(sizes)), pa.array(named.view(np.int64)), shingles], names=["doc_id", "h", "shingles"])

    return run


def _similar(i: int, others: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of ``others`` have a set that is similar enough to that of ``i``; sets are sorted."""
    own, sizes = sets[i], np.array([len(sets[j]) for j in others])
    flat = np.concatenate([sets[j] for j in others])
    at = np.minimum(np.searchsorted(own, flat), max(0, len(own) - 1))
    hit = own[at] == flat if len(own) else np.zeros(len(flat), bool)
    both = np.diff(np.append(0, np.cumsum(hit))[np.append(0, np.cumsum(sizes))])
    return others[both >= similarity * (len(own) + sizes - both)]


def _near_labels(radius: int, similarity: float):
    """Rows sorted by bucket become edges between the labels of texts that are within ``radius`` bits of each other and similar enough.

    Pairs are checked where they are met, against their sets, and only while their labels are not connected yet; so a
    bucket yields fewer edges than it has labels.
    """

    def block(fp: list[np.ndarray], h: list[np.ndarray], label: list[np.ndarray], sets: list[list[np.ndarray]]):
        fp, h, label, sets = np.concatenate(fp), np.concatenate(h), np.concatenate(label), [x for part in sets for x in part]
        by = np.argsort(h)
        by = by[np.append(True, h[by][1:] != h[by][:-1])]
        fp, label, sets = fp[by], label[by], [sets[i] for i in by.tolist()]
        known, group = np.unique(label, return_inverse=True)
        edges: list[tuple[int, int]] = []
        for a in range(0, len(fp), CHECKED):
            for b in range(a, len(fp), CHECKED):
                rows = np.arange(a, min(a + CHECKED, len(fp)))
                if a != b:
                    rows = np.append(rows, np.arange(b, min(b + CHECKED, len(fp))))
                i, j = links_within(fp[rows], radius)
                i, j = rows[i], rows[j]
                order = np.argsort(i, kind="stable")
                i, j = i[order], j[order]
                starts = np.append(0, np.nonzero(i[1:] != i[:-1])[0] + 1) if len(i) else []
                for s, e in zip(starts, np.append(starts[1:], len(i)).astype(int) if len(i) else []):
                    one, others = int(i[s]), j[s:e]
                    others = others[group[others] != group[one]]
                    if not len(others):
                        continue
                    for other in _similar(one, others, sets, similarity).tolist():
                        x, y = int(group[one]), int(group[other])
                        if x != y:
                            edges.append((int(known[x]), int(known[y])))
                            group[group == max(x, y)] = min(x, y)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        held, last = [], None
        for batch in batches:
            bucket, fp, h, label = (batch.column(c).to_numpy() for c in ("bucket", "fp", "h", "label"))
            sets = [x.values.to_numpy() for x in batch.column("shingles")]
            starts = np.append(0, np.nonzero(bucket[1:] != bucket[:-1])[0] + 1) if len(bucket) else []
            for s, e in zip(starts, np.append(starts[1:], len(bucket))):
                if held and bucket[s] != last:
                    yield block(*zip(*held))
                    held = []
                held.append((fp[s:e], h[s:e], label[s:e], sets[s:e]))
                last = bucket[s]
        if held:
            yield block(*zip(*held))

    return run


def similar_documents(docs: DataFrame, similarity: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, component_id): one row for each different row of ``docs`` with an id and a text.

    Texts link if the Jaccard similarity of their ``size``-word shingles is at least ``similarity`` (0.8 or more; words as for
    fingerprints, a shorter text is one shingle); those without words link with each other. Every link that is used has been checked exactly. Which pairs are checked:
    those that share a key of ``MINIMA`` minima and whose fingerprints differ in at most ``FAR`` bits, but for pairs that are connected already.
    ``component_id`` is the smallest id reached, the row's own included. ``text_hash`` (xxhash64 of the text) tells rows of one id apart.
    Rows with a null id or text are not listed; repeated rows count once.
    """
    texts = distinct_texts(docs, id_col, text_col)
    run, schema = _sketches(size)
    sketches = cut(texts.select("doc_id", "text").mapInArrow(released(run), schema))
    keys = [f"k{i}" for i in range(BANDS)]
    # Equal texts are one node, named by the first hash; the second tells by chance equal ones apart.
    nodes = cut(sketches.groupBy("h", "g").agg(F.min("doc_id").alias("least"), *(F.min(c).alias(c) for c in ("fp", "n", *keys))))
    rows = nodes.select("h", "fp", "n", "least", F.explode(F.array(*keys)).alias("bucket"))
    heads = cut(rows.groupBy("bucket").agg(F.min(F.struct("h", "least")).alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = cut(rows.join(heads.select("bucket", "head"), "bucket"))

    def sets_of(ids: DataFrame) -> DataFrame:
        """(doc_id, h, shingles) of the texts that ``ids`` (key) may name; others are not shuffled."""
        asked = possible_hits(texts.select("doc_id", "text"), ids, "doc_id", "key", ids.count())
        return asked.mapInArrow(released(_sets(size)), "doc_id long, h long, shingles array<int>")

    star = shared.filter(F.col("h") != F.col("head.h")).select(F.col("h").alias("a"), F.col("least").alias("a_id"), F.col("head.h").alias("b"), F.col("head.least").alias("b_id")).distinct()
    star = cut(star)
    sets = sets_of(cut(star.select(F.col("a_id").alias("key")).unionByName(star.select(F.col("b_id").alias("key"))).distinct()))
    left = star.join(sets, (F.col("a_id") == F.col("doc_id")) & (F.col("a") == F.col("h"))).withColumnRenamed("shingles", "x").drop("doc_id", "h")
    known = left.join(sets, (F.col("b_id") == F.col("doc_id")) & (F.col("b") == F.col("h")))
    both = F.size(F.array_intersect("x", "shingles"))
    links = cut(known.filter(both >= F.lit(similarity) * (F.size("x") + F.size("shingles") - both)).select("a", "b"))
    components = connected_components(links)
    # What is left: buckets that hold several components. Their pairs are compared and checked in the bucket.
    label = F.coalesce("component", "h")
    labelled = cut(shared.join(components.withColumnRenamed("node", "h"), "h", "left").select("bucket", "fp", "h", "n", "least", label.alias("label")))
    several = cut(labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket"))
    if not several.isEmpty():
        # Ids are dealt out first; each part of a bucket then gets its sets, of bounded size together.
        rows = cut(_parted(labelled.join(several, "bucket", "left_semi"), "h", "n"))
        sets = sets_of(cut(rows.select(F.col("least").alias("key")).distinct())).withColumnRenamed("h", "hash")
        rows = rows.join(sets, (F.col("least") == F.col("doc_id")) & (F.col("h") == F.col("hash"))).select("bucket", "fp", "h", "label", "shingles")
        more = cut(_gathered(rows).mapInArrow(released(_near_labels(FAR, similarity)), "a long, b long").distinct())
        if not more.isEmpty():
            components = connected_components(links.unionByName(more))
    named = _named(nodes.select(F.col("h").alias("node"), "least"), components)
    hashed = texts.select("doc_id", "text_hash")
    known = sketches.select("doc_id", "h").join(named, F.col("h") == F.col("node")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return hashed.join(known, "doc_id")


def keep_one(docs: DataFrame, similarity: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each group of ``similar_documents``: that of the smallest id.

    Of rows that share that id, one stays (the first by text). Rows whose id is null cannot be named in a
    group and stay, and so does one row of each id whose text is null. Only ids are compared here; texts are shuffled once, to the ids that stay.
    """
    groups = similar_documents(docs, similarity, size, id_col, text_col)
    gone = cut(groups.groupBy("doc_id").agg(F.min("component_id").alias("component_id")).filter("component_id <> doc_id").select(F.col("doc_id").alias(fresh("gone", docs.columns))))
    ident = F.col(id_col).cast("long")
    kept = docs.join(gone, ident == gone[gone.columns[0]], "left_anti")
    twice = cut(kept.filter(F.col(id_col).isNotNull()).groupBy(ident.alias(fresh("twice", docs.columns))).count().filter("count > 1").drop("count"))
    if twice.isEmpty():
        return kept
    again = ident == twice[twice.columns[0]]
    rows = kept.join(twice, again, "left_semi")
    first = rows.groupBy(ident.alias("id")).agg(F.min_by(F.struct(*docs.columns), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("row"))
    return kept.join(twice, again, "left_anti").unionByName(first.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
