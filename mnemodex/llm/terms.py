"""Terms of many texts at once: maximal runs of some bytes, with their places and hashes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from mnemodex.llm.words import _BASE, _powers, mixed

#: Bytes of text that are cut together; a longer text is one block.
BLOCK = 1_000_000

_LOWERED = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_FORTH, _BACK = _powers(BLOCK, _BASE), _powers(BLOCK, pow(_BASE, -1, 1 << 64))


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    inside = np.zeros(256, bool)
    for first, last in ranges:
        inside[first : last + 1] = True
    return inside


#: Letters and all that isn't ASCII; the same with digits.
LETTERS = _bytes((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LETTERS_DIGITS = LETTERS | _bytes((0x30, 0x39))


class Terms(NamedTuple):
    """The terms of some texts, in order: bytes (A-Z lower-cased), places in them, hashes, and the number of terms of each text."""

    raw: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray

    def strings(self, at: np.ndarray) -> pa.Array:
        """The terms of some places as strings."""
        places, offsets = spread(self.starts[at], self.lengths[at])
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(self.raw[places]))


def spread(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the places of all ranges one after another, where each range begins among them and all end)."""
    offsets = np.append(0, np.cumsum(lengths))
    return np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths), offsets


def _cut(raw: np.ndarray, edges: np.ndarray, inside: np.ndarray) -> Terms:
    n = len(raw)
    if not n:
        none = np.empty(0, np.int64)
        return Terms(raw, none, none, none.astype(np.uint64), np.zeros(len(edges) - 1, np.int64))
    within = inside[raw]
    first, last = within.copy(), within.copy()
    first[1:] &= ~within[:-1]
    last[:-1] &= ~within[1:]
    # Texts lie next to each other, so their ends part terms too.
    inner = edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < n)]
    first[inner] = within[inner]
    last[inner - 1] = within[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    lowered = _LOWERED[raw]
    forth, back = (_FORTH[:n], _BACK) if n <= BLOCK else (_powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64)))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((lowered + np.uint64(1)) * forth, out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * back[starts])
    return Terms(lowered, starts, ends - starts, hashes, np.diff(np.searchsorted(starts, edges)))


def cut_terms(texts: pa.Array, inside: np.ndarray) -> Iterator[tuple[int, Terms]]:
    """(number of the first text, terms) of blocks of ``texts``. A null text has no term."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + BLOCK, side="right")) - 1)
        yield first, _cut(raw[edges[first] : edges[last]], edges[first : last + 1] - edges[first], inside)
        first = last
