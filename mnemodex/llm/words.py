"""Hashes of the words of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text whose words are hashed together; a longer text is one block.
BLOCK = 250_000

_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers, after which each bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n - 1, np.uint64(base))))


_FORTH, _BACK = _powers(BLOCK, _BASE), _powers(BLOCK, pow(_BASE, -1, 1 << 64))


def _block(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words of each text) of the texts between ``edges`` of ``raw``."""
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(edges) - 1, np.int64)
    inside = ~_SPACE[raw]
    before, behind = np.append(False, inside[:-1]), np.append(inside[1:], False)
    before[edges[:-1][edges[:-1] < n]] = False
    behind[edges[1:][edges[1:] > 0] - 1] = False
    starts, ends = np.nonzero(inside & ~before)[0], np.nonzero(inside & ~behind)[0] + 1
    forth, back = (_FORTH[:n], _BACK) if n <= BLOCK else (_powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64)))
    sums = np.append(np.uint64(0), np.cumsum(_LOWER[raw] * forth))
    return mixed((sums[ends] - sums[starts]) * back[starts]), np.diff(np.searchsorted(starts, edges))


def hashed_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, 64-bit hashes of the words, words of each text) of blocks of ``texts``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A null text has none.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + BLOCK, side="right")) - 1)
        yield first, *_block(raw[edges[first] : edges[last]], edges[first : last + 1] - edges[first])
        first = last
