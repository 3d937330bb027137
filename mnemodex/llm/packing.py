"""Best-fit packing of documents into sequences, certified by lower bounds.

Documents are tokenized once; only their pieces' lengths travel. Each partition packs
its pieces by best-fit decreasing and compares its number of sequences with a lower bound from dual
feasible functions. A partition that meets the bound is certified and done. The others keep
their full sequences, exchange the documents of the sequences that have room, and those are packed anew in
fewer partitions, until all are certified or one partition holds what is left over.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemodex.llm.common import cut
from mnemodex.llm.tokens import TokenBytes

#: Pieces that one task packs at a time.
GROUP = 20_000
ROUNDS = 12

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int, end_id: int):
    def run(batches):
        encode = TokenBytes(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            texts, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, texts):
                body = encode(text.as_py() or "") + end
                n = len(body) // 4
                first = n % capacity or capacity  # the remainder comes first, so that the others are full
                starts = [0, *range(first, n, capacity)]
                for piece, start in enumerate(starts):
                    size = first if not piece else capacity
                    rows.append((doc_id, piece, start, size, zlib.crc32(body[4 * start : 4 * (start + size)])))
            columns = list(zip(*rows)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def document_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids with ``end_id`` at the end, cut only if longer than ``capacity``.

    A null text is an empty one. Of a longer document the first piece is the shorter one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_cut(tokenizer, capacity, end_id), _PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length. Bins are kept by room; the set bits of one integer tell which rooms occur."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n_bins = 0, 0
    for at in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[at])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen, n_bins = capacity, n_bins, n_bins + 1
        bins[at], offsets[at] = chosen, capacity - room
        left = room - size
        by_room[left].append(chosen)
        rooms |= 1 << left
    return bins, offsets


def best_fit_sets(lengths: np.ndarray, capacity: int, looks: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing by sets: the largest piece opens a bin, which one, two or three more pieces then fill exactly.

    Where no such set is left, the largest piece that fits goes in. The lengths that are
    left are the bits of one integer; a pair with a given sum shows as a common bit of it and its mirror image.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_size: list[list[int]] = [[] for _ in range(capacity + 1)]
    for at in np.argsort(lengths, kind="stable").tolist():
        by_size[int(lengths[at])].append(at)
    sizes = mirror = 0
    for size, held in enumerate(by_size):
        if held:
            sizes |= 1 << size
            mirror |= 1 << (capacity - size)

    def take(size: int, chosen: int, offset: int) -> int:
        nonlocal sizes, mirror
        at = by_size[size].pop()
        if not by_size[size]:
            sizes &= ~(1 << size)
            mirror &= ~(1 << (capacity - size))
        bins[at], offsets[at] = chosen, offset
        return offset + size

    def pair(total: int) -> int:
        """The larger length of a pair that is left and has this sum, or 0."""
        both = sizes & (mirror >> (capacity - total)) & ((1 << total) - 1) & ~1
        while both:
            one = both.bit_length() - 1
            if 2 * one != total or len(by_size[one]) > 1:
                return one
            both &= ~(1 << one)
        return 0

    chosen = -1
    while sizes:
        chosen += 1
        offset = take(sizes.bit_length() - 1, chosen, 0)
        while offset < capacity:
            room = capacity - offset
            fitting = sizes & ((2 << room) - 1)
            if not fitting:
                break
            if fitting >> room & 1:
                offset = take(room, chosen, offset)
                continue
            if one := pair(room):
                offset = take(room - one, chosen, take(one, chosen, offset))
                continue
            third, tries, rest = 0, 0, fitting
            while rest and tries < looks:
                size = rest.bit_length() - 1
                rest &= ~(1 << size)
                tries += 1
                held = by_size[size].pop()  # the pair must not need the same piece
                lone = not by_size[size]
                if lone:
                    sizes &= ~(1 << size)
                    mirror &= ~(1 << (capacity - size))
                one = pair(room - size)
                by_size[size].append(held)
                if lone:
                    sizes |= 1 << size
                    mirror |= 1 << (capacity - size)
                if one:
                    third = size
                    break
            offset = take(third or fitting.bit_length() - 1, chosen, offset)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound on the number of bins from two families of dual feasible functions.

    f_k rounds sizes so that those over capacity - k fill a bin and those under k vanish; u_p rounds x (p + 1) / capacity
    down unless it is whole. Their sums, like the plain sum, never exceed the number of bins.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    total, large = np.cumsum(count * size), np.cumsum(count[::-1])[::-1]
    for k in range(1, capacity // 2 + 1):
        middle = int(total[capacity - k] - total[k - 1])
        full = int(large[capacity - k + 1]) if k else 0
        best = max(best, full + -(-middle // capacity))
    for p in range(1, 100):
        scaled = size * (p + 1)
        value = np.where(scaled % capacity == 0, size * p, (scaled // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (p * capacity)))
    return best


def _pack(capacity: int):
    def run(rows: pa.Table) -> pa.Table:
        lengths = rows["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        if bins.max(initial=-1) + 1 > bound:
            others = best_fit_sets(lengths, capacity)
            if others[0].max() < bins.max():
                bins, offsets = others
        n = int(bins.max(initial=-1)) + 1
        certified = n <= bound
        filled = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        done = np.full(len(bins), True) if certified else filled[bins] == capacity
        names = ["part", "doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.table([*(rows[c] for c in names), bins, offsets, done], names=[*names, "bin", "offset", "done"])

    return run


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` with sequence_id and offset: no sequence is longer than ``capacity``, offsets are gapless from 0.

    Pieces are told apart by their row, so repeated ids and rows do no harm, nor do null ids. Of equal lengths any order may come out.
    An empty table gives an empty one.
    """
    schema = "part long, " + _PIECES + ", bin long, offset long, done boolean"
    left, result = pieces, None
    for turn in range(ROUNDS):
        n = left.count()
        if not n:
            break
        groups = max(1, -(-n // GROUP))
        # Each round deals anew, so that documents of partitions with gaps meet others. Rows are numbered, so that repeated ones part.
        key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(turn)), F.lit(groups))
        packed = cut(left.withColumn("part", key).groupBy("part").applyInArrow(_pack(capacity), schema))
        last = groups == 1 or turn == ROUNDS - 1
        done = packed if last else packed.filter("done")
        numbered = done.withColumn("sequence_id", (F.lit(turn).cast("long") * F.lit(1 << 56)) + F.col("part") * F.lit(1 << 24) + F.col("bin"))
        numbered = numbered.drop("part", "bin", "done")
        result = numbered if result is None else result.unionByName(numbered)
        if last:
            break
        left = packed.filter("not done").drop("part", "bin", "offset", "done")
    if result is None:
        result = pieces.withColumn("offset", F.lit(0).cast("long")).withColumn("sequence_id", F.lit(0).cast("long"))
    return result


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): ``docs`` in as few sequences as can be.

    A row for each piece. ``ids_crc32`` is the CRC-32 of the piece's ids as little-endian unsigned
    32-bit numbers. Null texts are empty (one id: ``end_id``); repeated rows are packed each on its own; extra columns are ignored.
    """
    return pack_pieces(cut(document_pieces(docs, tokenizer, capacity, end_id, id_col, text_col)), capacity)
