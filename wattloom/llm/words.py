"""Words of whole texts as arrays: places, owners and 64-bit hashes, without a Python loop over words.

Texts arrive as Arrow strings. Every separator used here is an ASCII character, so words are cut on
the UTF-8 bytes, and all bytes from 0x80 up belong to words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer single text is one slice of its own.
SLICE_BYTES = 1 << 20

U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _table(separators: str) -> np.ndarray:
    table = np.ones(256, bool)
    table[[ord(c) for c in separators]] = False
    return table


#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, read after lower-casing.
ALNUM = _table("".join(chr(c) for c in range(128) if not chr(c).isalnum()))
#: Word bytes of `[^\x20\x09-\x0D]+`.
SPACED = _table("\t\n\x0b\x0c\r ")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = U64(0x9E3779B97F4A7C15 | 5)
_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd base, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, U64), np.cumprod(np.full(max(n, 64) * 2, _BASE, U64))])
    return _powers[:n]


class Words(NamedTuple):
    """Words of a run of texts: byte places, hash, and for each text where its words begin."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of Arrow strings; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``limit`` bytes together, or of one longer text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of non-empty byte spans that do not overlap, in order."""
    if not len(start):
        return np.zeros(0, U64)
    lens = end - start
    begin = np.cumsum(lens) - lens
    within = np.arange(int(lens.sum())) - np.repeat(begin, lens)
    body = data[within + np.repeat(start, lens)]
    return mix(np.add.reduceat(_BYTE[body] * powers(int(lens.max()))[within], begin))


def split(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = True) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``; A-Z become a-z first if ``lower``."""
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = kind[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = np.unique(cut[(inside[cut] > 0) & (inside[cut + 1] > 0)])  # a word may not cross into the next text
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return Words(start, end, hash_spans(data, start, end), np.searchsorted(start, offsets))


def give_back() -> None:
    """Returns freed memory to the system, which Arrow and the C library otherwise keep for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def runs(texts: pa.Array, kind: np.ndarray, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, Words]]:
    """Slices of a column of texts: first and last text, their bytes, their words."""
    data, offsets = utf8(texts)
    for i, j in slices(offsets):
        own = data[offsets[i] : offsets[j]]
        yield i, j, own, split(own, offsets[i : j + 1] - offsets[i], kind, lower)
    give_back()


def gram_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` hashes (one per start); runs across texts must be left out by the caller."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    p, size = powers(n), len(hashes) - n + 1
    total = np.zeros(size, U64)
    for k in range(n):
        total += hashes[k : k + size] * p[k]
    return mix(total + U64(n))


def gram_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Starts of runs of ``n`` words that lie inside one text."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    begin = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(begin, counts) + np.repeat(first[:-1], counts)


def word_hash(text: str) -> int:
    """Hash of one word as the arrays have it."""
    data = np.frombuffer(text.encode(), np.uint8)
    return int(hash_spans(data, np.array([0]), np.array([len(data)]))[0])
