"""Byte-level BPE: encoding by a segment tree over the ranks of adjacent pairs, and decoding.

Text is cut into pieces as the vocabulary's pre-tokenizer does, and each piece is merged on its own. The leaves of a piece's
tree are the ranks of its adjacent pairs, so the root names the leftmost pair of the lowest rank. A merge changes three leaves (the
pair itself and its two neighbours), each of which is carried up to the root; it ends when the root has no rank.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemodex.llm.common import fresh
from mnemodex.llm.tokens import _UNUSUAL

#: A cache starts anew once it holds so many keys.
CACHED = 400_000
#: Pieces of at most so many bytes are merged many at a time, so many of them at once; longer ones alone.
SHORT, TOGETHER = 64, 20_000
#: Characters of the texts that are cut before their new pieces are merged together.
SLICE = 2_000_000
_NONE = np.iinfo(np.int64).max


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = (chr(0x100 + i) for i in range(256))
    return [chr(b) if b in own else next(moved) for b in range(256)]


class Merges:
    """The merge rules of a byte-level vocabulary, and pieces merged by them."""

    def __init__(self, model: dict, added: Iterable[dict] = ()) -> None:
        if model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE is supported")
        ids, letters = model["vocab"], byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {x["content"]: x["id"] for x in added}
        self.size = 1 + max([*ids.values(), *self.special.values()])
        self.token = [b""] * self.size
        for text, i in ids.items():
            self.token[i] = bytes(map(self.byte_of.__getitem__, text)) if all(c in self.byte_of for c in text) else text.encode()
        for text, i in self.special.items():
            self.token[i] = text.encode()
        self.byte_ids = np.array([ids[c] for c in letters], np.int64)
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = np.array([ids[a] * (self.size + 1) + ids[b] for a, b in pairs], np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        self.ranks = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[self.ranks], _NONE)
        self.ranks = np.append(self.ranks, -1)

    def _leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, shift: int) -> np.ndarray:
        """rank << shift | place of each pair; ``_NONE`` where there is no rule."""
        key = left * (self.size + 1) + right
        found = np.searchsorted(self.keys, key)
        return np.where(self.keys[found] == key, self.ranks[found] << shift | at, _NONE)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each of many pieces, as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            groups.setdefault(max(1, (len(piece) - 1).bit_length()) if len(piece) <= SHORT else 0, []).append(i)
        for i in groups.pop(0, []):
            out[i] = self.merge_long(pieces[i])
        for shift, members in groups.items():
            for first in range(0, len(members), TOGETHER):
                part = members[first : first + TOGETHER]
                for i, ids in zip(part, self._merge_short([pieces[i] for i in part], shift)):
                    out[i] = ids
        return out

    def _merge_short(self, pieces: list[bytes], shift: int) -> list[bytes]:
        """Pieces of at most ``1 << shift`` bytes, a row each; every step makes one merge in each row that has one left."""
        n, rows = 1 << shift, len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, rows)
        raw = np.frombuffer(b"".join(p.ljust(n, b"\0") for p in pieces), np.uint8).reshape(rows, n)
        place = np.arange(n)
        # Column n stands for what lies outside a piece: a symbol that no rule has.
        symbol = np.full((rows, n + 1), self.size, np.int64)
        symbol[:, :n] = np.where(place < lengths[:, None], self.byte_ids[raw], self.size)
        after, before = np.tile(np.append(place + 1, n), (rows, 1)), np.tile(np.append(np.append(n, place[:-1]), n), (rows, 1))
        alive = place < lengths[:, None]
        tree = np.full((rows, 2 * n), _NONE, np.int64)
        tree[:, n:] = self._leaves(symbol[:, :n], symbol[:, 1:], place, shift)
        for level in range(shift - 1, -1, -1):
            low = 1 << level
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
        row = np.nonzero(tree[:, 1] != _NONE)[0]
        while len(row):
            root = tree[row, 1]
            at = root & (n - 1)
            gone = after[row, at]
            behind = after[row, gone]
            symbol[row, at] = self.made[root >> shift]
            after[row, at], before[row, behind] = behind, at
            alive[row, gone] = False
            prior = before[row, at]
            prior = np.where(prior == n, at, prior)
            tree[row, n + gone] = _NONE
            tree[row, n + at] = self._leaves(symbol[row, at], symbol[row, behind], at, shift)
            tree[row, n + prior] = self._leaves(symbol[row, prior], symbol[row, after[row, prior]], prior, shift)
            for leaf in (gone, at, prior):
                node = n + leaf
                for _ in range(shift):
                    node = node >> 1
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            row = row[tree[row, 1] != _NONE]
        ids = symbol[:, :n][alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(alive.sum(axis=1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def merge_long(self, piece: bytes) -> bytes:
        """One piece of any length: n log n steps."""
        length = len(piece)
        shift = max(1, (length - 1).bit_length())
        n, wide, rank_of = 1 << shift, self.size + 1, self.rank_of
        symbol = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, length + 1)), list(range(-1, length - 1))
        tree = np.full(2 * n, _NONE, np.int64)
        if length > 1:
            pair = np.array(symbol, np.int64)
            tree[n : n + length - 1] = self._leaves(pair[:-1], pair[1:], np.arange(length - 1), shift)
        for level in range(shift - 1, -1, -1):
            low = 1 << level
            tree[low : 2 * low] = np.minimum(tree[2 * low : 4 * low : 2], tree[2 * low + 1 : 4 * low : 2])
        tree, none, made = tree.tolist(), int(_NONE), self.made

        def put(at: int, leaf: int) -> None:
            node = n + at
            tree[node] = leaf
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    break
                tree[node] = least

        def pair_at(at: int) -> int:
            behind = after[at]
            rank = rank_of.get(symbol[at] * wide + symbol[behind]) if behind < length else None
            return none if rank is None else rank << shift | at

        while tree[1] != none:
            at = tree[1] & (n - 1)
            gone = after[at]
            symbol[at], symbol[gone] = int(made[tree[1] >> shift]), -1
            after[at] = after[gone]
            if after[at] < length:
                before[after[at]] = at
            put(gone, none)
            put(at, pair_at(at))
            if before[at] >= 0:
                put(before[at], pair_at(before[at]))
        return np.array([s for s in symbol if s >= 0], "<u4").tobytes()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of some ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


class Encoder:
    """Ids of texts under the vocabulary file at ``path`` (its special tokens are recognised in text), through caches of words and pieces."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before, added = spec["pre_tokenizer"], spec.get("added_tokens", [])
        if spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("only plain byte-level BPE is supported")
        self.merges = Merges(spec["model"], added)
        self.cut_unusual = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.cut_word = regex.compile(PATTERN).findall
        longest = sorted(self.merges.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        #: Words that begin a line, words after a space, pieces of words, and pieces in the byte alphabet, each with its ids.
        self.first, self.later, self.pieces, self.lettered = {}, {}, {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        for cache in (self.first, self.later, self.pieces, self.lettered):
            if len(cache) > CACHED:
                cache.clear()
        cuts, firsts, laters, letters = [], set(), set(), set()
        for text in texts:
            if not text or text[0] not in " \n" and not _UNUSUAL.search(text):
                lines = [line.split(" ") for line in text.split("\n")] if text else []
                for words in lines:
                    firsts.add(words[0])
                    laters.update(words[1:])
                cuts.append((True, lines))
            else:
                parts = self.special.split(text) if self.special else [text]
                # Every second part is a special token.
                parts = [part if i % 2 else [piece for piece, _ in self.cut_unusual(part)] for i, part in enumerate(parts) if part]
                letters.update(piece for part in parts if isinstance(part, list) for piece in part)
                cuts.append((False, parts))
        self._learn(self.lettered, {x: bytes(map(self.merges.byte_of.__getitem__, x)) for x in letters if x not in self.lettered})
        self._words(self.first, "", firsts)
        self._words(self.later, " ", laters | {"\n"})
        first, later, lettered, line_end = self.first, self.later.__getitem__, self.lettered.__getitem__, self.pieces["\n"]
        out = []
        for ordinary, parts in cuts:
            if ordinary:
                out.append(line_end.join([first[words[0]] + b"".join(map(later, words[1:])) for words in parts]))
            else:
                out.append(b"".join(b"".join(map(lettered, part)) if isinstance(part, list) else self.merges.special[part].to_bytes(4, "little") for part in parts))
        return out

    def _learn(self, cache: dict, new: dict[str, bytes]) -> None:
        cache.update(zip(new, self.merges.merge_many(list(new.values()))))

    def _words(self, cache: dict[str, bytes], lead: str, words: set[str]) -> None:
        cut = {w: self.cut_word(lead + w) for w in words if w not in cache}
        self._learn(self.pieces, {p: p.encode() for p in {p for pieces in cut.values() for p in pieces} | {"\n"} if p not in self.pieces})
        known = self.pieces.__getitem__
        cache.update((w, b"".join(map(known, pieces))) for w, pieces in cut.items())


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _lists(packed: list[bytes]) -> pa.ListArray:
    ends = np.cumsum(np.fromiter((len(x) // 4 for x in packed), np.int64, len(packed)))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))


def _slices(texts: pa.Array) -> Iterable[list[str]]:
    part, size = [], 0
    for text in texts:
        text = text.as_py() or ""
        part.append(text)
        size += len(text)
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``ids`` (array of int) and ``decoded``, the text that the ids stand for.

    The ids are those of ``tokenizers`` with the same file and ``add_special_tokens=False``. A null text is an empty one: no ids, and
    decoded to "". Rows stay as they are, repeated ones included; of columns named ``ids`` or ``decoded`` the input's own get ``_`` before their
    names. One pass over the texts, no shuffle; memory is a slice of texts and caches of bounded size.
    """
    others = [i for i, c in enumerate(docs.columns) if c != text_col]
    plain = docs.toDF(*(f"_{i}" for i in range(len(docs.columns)))).withColumnRenamed(f"_{docs.columns.index(text_col)}", "text")
    plain = plain.select(*(f"_{i}" for i in others), F.col("text").cast("string").alias("text"))
    schema = ", ".join([*(f"_{i} {plain.schema[f'_{i}'].dataType.simpleString()}" for i in others), "ids array<int>", "decoded string"])

    def run(batches):
        encoder = _encoder(path)
        token = encoder.merges.token.__getitem__
        for batch in batches:
            at = 0
            for texts in _slices(batch.column("text")):
                packed = encoder.encode(texts)
                decoded = [b"".join(map(token, np.frombuffer(x, "<u4").tolist())).decode("utf-8", "replace") for x in packed]
                rest = batch.slice(at, len(texts)).select([f"_{i}" for i in others])
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*rest.columns, _lists(packed), pa.array(decoded, pa.string())], names=[*rest.schema.names, "ids", "decoded"])

    names = [docs.columns[i] for i in others]
    kept = [fresh(n, ["ids", "decoded", *names]) if n.lower() in ("ids", "decoded") else n for n in names]
    return plain.mapInArrow(run, schema).toDF(*kept, "ids", "decoded")


def decode_documents(coded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``coded`` with ``decoded``: the text of each row's ids, special tokens included, as ``tokenizers`` decodes them.

    Null ids give a null text, no ids an empty one, ids outside the vocabulary nothing; a column named ``decoded`` is replaced.
    """
    inner = [f"_{i}" for i in range(len(coded.columns))]
    plain = coded.toDF(*inner)
    ids = inner[coded.columns.index(ids_col)]
    plain = plain.withColumn("ids", F.col(ids).cast("array<int>"))
    schema = ", ".join([*(f"{c} {plain.schema[c].dataType.simpleString()}" for c in inner), "decoded string"])

    def run(batches):
        merges = _encoder(path).merges
        for batch in batches:
            texts = [None if x is None else merges.decode(i for i in x if i is not None and 0 <= i < merges.size) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(inner).columns, pa.array(texts, pa.string())], names=[*inner, "decoded"])

    out = plain.mapInArrow(run, schema)
    named = [(i, c) for i, c in zip(inner, coded.columns) if c.lower() != "decoded"]
    return out.select(*(F.col(i).alias(c) for i, c in named), "decoded")
