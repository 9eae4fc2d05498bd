"""Words of texts as hashes: one numpy pass over the code points of a batch, no string call per row or word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from peneira.llm.glyphs import LETTER_BITS, MARK, WORD, code_points, info_of, plain_form

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 16, _FACTOR, np.uint64), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (the finaliser of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word in order. Words are runs of letters and digits of the plain form, without case and accents."""
    return words_of(*plain_form(*code_points(column)))


def words_of(cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes() of texts given as code points of their plain form."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    info = info_of(cps)
    mark = (info & MARK) > 0
    if mark.any():  # a mark that has no composed form belongs to its word but doesn't count
        bounds = np.concatenate([[0], np.cumsum(~mark)])[bounds]
        info = info[~mark]
    if not len(info):
        return none
    inside = info >= WORD
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(info)]
    start[edges] = inside[edges]
    first = np.flatnonzero(start)
    if not len(first):
        return none
    info = info[first[0] :]
    span = np.diff(np.append(first, len(info) + first[0]))
    place = np.arange(len(info), dtype=np.int32) - np.repeat((first - first[0]).astype(np.int32), span)
    if int(span.max()) > len(_POWERS):
        np.minimum(place, len(_POWERS) - 1, out=place)
    terms = _POWERS[place]
    terms *= np.where(info >= WORD, (info & LETTER_BITS) + 1, 0).astype(np.uint64)
    h = mix(np.add.reduceat(terms, first - first[0]))
    count = np.diff(np.searchsorted(first, bounds))
    return np.repeat(np.arange(len(count)), count), h


def hash_words(texts: list[str]) -> list[list[int]]:
    """The hashes of the words of a few texts, as word_hashes() gives them."""
    row, h = word_hashes(pa.array(texts, pa.string()))
    return [h[row == i].tolist() for i in range(len(texts))]


def ragged(row: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """An Arrow list array of n rows from values with their ascending rows."""
    offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
