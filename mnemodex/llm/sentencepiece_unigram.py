"""SentencePiece encoding by a unigram Viterbi search, and decoding.

The pieces lie in a double-array trie over their UTF-8 bytes. Texts are cut where no piece can
reach across (before white-space markers, around line ends); the parts that a worker has not met yet
are searched together, all of them one byte further at a time, so that both the walks
through the trie and the Viterbi steps are array operations.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: SentencePiece's penalty below the lowest score, for a character that no piece covers.
UNKNOWN_PENALTY = 10.0
#: Parts of a text that a worker remembers, parts that are searched together, and bytes up to which they are; bytes beyond which a part is searched alone.
CACHED, TOGETHER, SHORT, LONG = 500_000, 20_000, 32, 2000
_PART = re.compile(rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
_WHOLE = re.compile(r"(?s).+")


@dataclass
class Trie:
    """base[s] + byte is the next state of s, if check there is s. value: the piece that ends in a state, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: list[bytes]) -> Trie:
        """Place each state's children at the first base in a window of recent cells that has room for all of them."""
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size, window = 1 << 20, 2048
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0], top = 0, 1
        todo = [(0, 0, 0, len(order))]  # state, depth, range of the sorted keys
        while todo:
            state, depth, low, high = todo.pop()
            groups: list[tuple[int, int, int]] = []
            at = low
            while at < high:
                key = keys[order[at]]
                if len(key) == depth:
                    value[state] = order[at]
                    at += 1
                    continue
                end = at + 1
                while end < high and keys[order[end]][depth] == key[depth]:
                    end += 1
                groups.append((key[depth], at, end))
                at = end
            if not groups:
                continue
            labels = np.array([g[0] for g in groups])
            if top + 1024 >= size:
                base, check, value = (np.append(a, np.full(size, fill, np.int32)) for a, fill in ((base, 0), (check, -1), (value, -1)))
                size *= 2
            starts = np.arange(max(1, top - window - int(labels[0])), top + 1)
            start = int(starts[(check[starts[:, None] + labels] < 0).all(axis=1).argmax()])
            if not (check[start + labels] < 0).all():
                start = top
            base[state] = start
            check[start + labels] = state
            top = max(top, start + int(labels[-1]) + 1)
            todo += [(start + label, depth + 1, a, b) for label, a, b in groups]
        return cls(base[: top + 256], check[: top + 256], value[: top + 256])

    def step(self, states: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        to = self.base[states] + byte
        return np.where((self.check[to] == states) & (to > 0), to, -1)


@dataclass
class Model:
    pieces: list[str]
    scores: np.ndarray
    #: Kinds as in the file: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte.
    kinds: np.ndarray
    trie: Trie
    #: The ids in the order of the trie's values.
    ids: np.ndarray
    byte_ids: np.ndarray
    unknown: int
    dummy_prefix: bool
    part: re.Pattern

    @classmethod
    def load(cls, path: str) -> Model:
        """Read a model file; its normaliser has to be the identity (white space becomes markers, a prefix may be added)."""
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models with an identity normaliser can be used")
        return cls.of([(p.piece, p.score, p.type) for p in proto.pieces], spec.add_dummy_prefix)

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]], dummy_prefix: bool = True) -> Model:
        names, scores, kinds = [p[0] for p in pieces], np.array([p[1] for p in pieces], np.float32), np.array([p[2] for p in pieces])
        ids = np.nonzero((kinds == 1) | (kinds == 4))[0]
        byte_ids = np.full(256, -1)
        for i in np.nonzero(kinds == 6)[0]:
            byte_ids[int(names[i][1:-1], 16)] = i
        crossing = any("\n" in names[i] or MARK in names[i].lstrip(MARK) for i in ids)
        return cls(names, scores, kinds, Trie.build([names[i].encode() for i in ids]), ids, byte_ids, int(np.nonzero(kinds == 2)[0][0]), dummy_prefix, _WHOLE if crossing else _PART)


def viterbi(parts: list[bytes], model: Model) -> list[bytes]:
    """The ids (little-endian, 32 bits each) of the best segmentation of each part; a character no piece begins at is unknown, or its bytes.

    Of equal scores the segmentation whose last piece starts first wins; scores are added in single precision.
    """
    n, width = len(parts), max(map(len, parts))
    text = np.zeros((n, width + 1), np.int64)
    for i, part in enumerate(parts):
        text[i, : len(part)] = np.frombuffer(part, np.uint8)
    size = np.array([len(p) for p in parts])
    best = np.full((n, width + 1), -np.inf, np.float32)
    best[:, 0] = 0
    origin, piece = np.full((n, width + 1), -1), np.full((n, width + 1), -1)
    least = model.scores[model.kinds == 1].min() if (model.kinds == 1).any() else np.float32(0)
    lost = np.float32(least - np.float32(UNKNOWN_PENALTY))
    trie, scores = model.trie, model.scores[model.ids]

    def offer(rows, start, end, score, what):
        better = (origin[rows, end] < 0) | (score > best[rows, end])
        rows, end = rows[better], end[better]
        best[rows, end], origin[rows, end], piece[rows, end] = score[better], start, what[better]

    for start in range(width):
        rows = np.nonzero((size > start) & np.isfinite(best[:, start]) & ((text[:, start] & 0xC0) != 0x80))[0]
        if not len(rows):
            continue
        lead = text[rows, start]
        char = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        single = np.zeros(len(rows), bool)
        alive, state = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for at in range(start, width):
            inside = size[rows[alive]] > at
            alive, state = alive[inside], state[inside]
            state = trie.step(state, text[rows[alive], at])
            alive, state = alive[state >= 0], state[state >= 0]
            if not len(alive):
                break
            value = trie.value[state]
            ends = value >= 0
            who, what = alive[ends], value[ends]
            offer(rows[who], start, np.full(len(who), at + 1), best[rows[who], start] + scores[what], model.ids[what])
            single[who[char[who] == at + 1 - start]] = True
        other = np.nonzero(~single)[0]
        offer(rows[other], start, np.minimum(start + char[other], size[rows[other]]), best[rows[other], start] + lost, np.full(len(other), model.unknown))
    # Back from the ends, all parts at once: column k of ``path`` holds each part's (k + 1)-th piece from its end.
    end, columns, every = size.copy(), [], np.arange(n)
    while end.any():
        here = end > 0
        columns.append(np.where(here, piece[every, end], -1))
        end = np.where(here, origin[every, end], 0)
    path = np.stack(columns[::-1], axis=1).astype(np.int32) if columns else np.empty((n, 0), np.int32)
    known = path >= 0
    flat, ends = path[known].astype("<i4").tobytes(), (4 * known.sum(axis=1).cumsum()).tolist()
    out = [flat[a:b] for a, b in zip([0, *ends], ends)]
    if (model.byte_ids >= 0).all():
        for i in np.nonzero((path == model.unknown).any(axis=1))[0]:
            found, end = [], int(size[i])
            while end > 0:
                start, what = int(origin[i, end]), int(piece[i, end])
                found += [int(model.byte_ids[b]) for b in reversed(parts[i][start:end])] if what == model.unknown else [what]
                end = start
            out[i] = np.array(found[::-1], "<i4").tobytes()
    return out


def viterbi_long(part: bytes, model: Model) -> bytes:
    """The same for one part of any length: all its bytes walk through the trie at once, then the pieces found are joined byte by byte."""
    n, trie = len(part), model.trie
    text = np.frombuffer(part, np.uint8).astype(np.int64)
    starts = np.nonzero((text & 0xC0) != 0x80)[0]
    alive, state, depth = starts, np.zeros(len(starts), np.int64), 0
    found = []
    while len(alive):
        inside = alive + depth < n
        alive, state = alive[inside], state[inside]
        state = trie.step(state, text[alive + depth])
        alive, state, depth = alive[state >= 0], state[state >= 0], depth + 1
        value = trie.value[state]
        ends = value >= 0
        found.append((alive[ends], np.full(int(ends.sum()), depth), value[ends]))
    lead = text[starts]
    char = np.minimum(1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0), n - starts)
    start, size, value = (np.concatenate(c) for c in zip(*found, (starts, char, np.full(len(starts), -1))))
    by = np.lexsort((value < 0, size, start))
    start, size, value = start[by], size[by], value[by]
    new = np.append(True, (start[1:] != start[:-1]) | (size[1:] != size[:-1]))  # a piece goes before the unknown character of its place
    least = model.scores[model.kinds == 1].min() if (model.kinds == 1).any() else np.float32(0)
    score = np.where(value < 0, np.float32(least - np.float32(UNKNOWN_PENALTY)), model.scores[model.ids[value]] if len(model.ids) else np.float32(0)).astype(np.float32)
    what = np.where(value < 0, model.unknown, model.ids[value] if len(model.ids) else 0)
    best, origin, piece = [None] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    best[0] = np.float32(0)
    for s, e, w, p in zip(start[new].tolist(), (start + size)[new].tolist(), score[new], what[new].tolist()):
        if best[s] is not None:
            total = best[s] + w
            if best[e] is None or total > best[e]:
                best[e], origin[e], piece[e] = total, s, p
    spelled, out, end = (model.byte_ids >= 0).all(), [], n
    while end > 0:
        s, p = origin[end], piece[end]
        out += [int(model.byte_ids[b]) for b in reversed(part[s:end])] if p == model.unknown and spelled else [p]
        end = s
    return np.array(out[::-1], "<i4").tobytes()


class Encoder:
    """``encode_batch(texts)``: each text's ids as little-endian 32-bit numbers."""

    def __init__(self, model: Model) -> None:
        self.model, self.cache = model, {}

    def _learn(self, parts: list[str]) -> None:
        if len(self.cache) > CACHED:
            self.cache.clear()
        coded = [p.encode() for p in parts]
        self.cache.update((p, viterbi_long(c, self.model)) for p, c in zip(parts, coded) if len(c) > LONG)
        order = sorted((i for i in range(len(parts)) if len(coded[i]) <= LONG), key=lambda i: len(coded[i]))
        at = 0
        while at < len(order):
            longest = max(SHORT // 2, len(coded[order[at]])) * 5 // 4
            most, end = max(1, TOGETHER * SHORT // longest), at
            while end < len(order) and end - at < most and len(coded[order[end]]) <= longest:
                end += 1
            chosen = order[at:end]
            self.cache.update(zip([parts[i] for i in chosen], viterbi([coded[i] for i in chosen], self.model)))
            at = end

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        cut = [self.model.part.findall(((MARK if self.model.dummy_prefix else "") + t.replace(" ", MARK)) if t else "") for t in texts]
        new = {p for parts in cut for p in parts if p not in self.cache}
        if new:
            if len(self.cache) + len(new) > CACHED:
                self.cache.clear()
                new = {p for parts in cut for p in parts}
            self._learn(list(new))
        return [b"".join(map(self.cache.__getitem__, parts)) for parts in cut]


def decode(ids: list[int], model: Model) -> str:
    """The text of ``ids``: bytes are joined and decoded, markers become spaces, the dummy prefix goes; control pieces have no text."""
    out = bytearray()
    for i in ids:
        kind = model.kinds[i]
        if kind == 6:
            out.append(int(model.pieces[i][1:-1], 16))
        elif kind == 2:
            out += " ⁇ ".encode()
        elif kind != 3:
            out += model.pieces[i].encode()
    text = out.decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if model.dummy_prefix and text.startswith(" ") else text


class Decoder:
    """The same for whole arrays of ids, by a table of the pieces' bytes."""

    def __init__(self, model: Model) -> None:
        self.prefix = model.dummy_prefix
        self.table = [b"" if k == 3 else " ⁇ ".encode() if k == 2 else bytes([int(p[1:-1], 16)]) if k == 6 else p.replace(MARK, " ").encode() for p, k in zip(model.pieces, model.kinds)]

    def __call__(self, ids: bytes) -> str:
        text = b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<i4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encode_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", batch: int = 512) -> DataFrame:
    """(doc_id, ids, decoded): the ids of every whole text, and what they decode to. One row for each row of ``docs``.

    A null text gives null ids and a null text, an empty one an empty list. Texts that hold the marker
    character itself decode with a space in its place; all others decode to themselves. Extra columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        encoder, back = Encoder(held.value), Decoder(held.value)
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                texts = part.column("text").to_pylist()
                coded = encoder.encode_batch([t or "" for t in texts])
                sizes = np.array([0] + [len(c) // 4 for c in coded]).cumsum().astype(np.int32)
                gone = pa.array([t is None for t in texts])
                ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.frombuffer(b"".join(coded), "<i4")), mask=gone)
                decoded = pa.array([None if t is None else back(c) for t, c in zip(texts, coded)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, decoded], names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode_documents(rows: DataFrame, model: Model, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): what each row's ids decode to. One row for each row; null ids give a null text, ids that are null or unknown to the model no text."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    known = F.filter(F.col(ids_col).cast("array<int>"), lambda i: i.between(0, len(model.pieces) - 1))
    coded = rows.select(F.col(id_col).cast("long").alias("doc_id"), known.alias("ids"))

    def run(batches):
        back = Decoder(held.value)
        for batch in batches:
            texts = [None if not ids.is_valid else back(ids.values.to_numpy().astype("<i4").tobytes()) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.mapInArrow(run, "doc_id long, text string")
