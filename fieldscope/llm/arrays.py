"""Whole Arrow batches as numpy arrays: bytes, words, and rolling hashes of both.

These run inside Spark tasks on one batch or one block of documents at a time.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# The functions run on executors that may not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = 1 << 18  # bytes hashed in one go, so that work arrays stay small: a worker keeps the memory of the largest


def worker_cache(name: str, build):
    """What ``build`` returns, kept for the next tasks of this Python worker until another name is asked for.

    Workers are handed from stage to stage: one that goes on to other work lets go of what it held.
    """
    store = sys.modules.setdefault("_fieldscope_worker", types.ModuleType("_fieldscope_worker"))
    if getattr(store, "name", None) != name:
        store.name = store.value = None
        store.value = build()
        store.name = name
    return store.value


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null as empty) and its n + 1 offsets."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    array = array.cast(pa.large_string()).fill_null("")
    _, ends, data = array.buffers()
    offsets = np.frombuffer(ends, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _base(seed: int) -> int:
    return int(mix(np.array([seed + 77], np.uint64))[0]) | 5


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    held = worker_cache("powers", dict)
    if seed not in held or len(held[seed][0]) < n:
        size = max(n, PIECE + 1)
        base = _base(seed)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        held[seed] = tuple(both)
    return held[seed][0][:n], held[seed][1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Rabin-Karp hash of values[start:end] for ascending spans: a difference of prefix sums, shifted to power 0.

    ``values`` are 64-bit codes; equal sequences give equal hashes wherever they stand.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        upto = max(at + 1, int(np.searchsorted(starts, low + PIECE)))
        high = int(ends[at:upto].max())
        powers, inverse = _powers(seed, high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[low:high] * powers[:-1], out=sums[1:])
        a, b = starts[at:upto] - low, ends[at:upto] - low
        out[at:upto] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
        at = upto
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word ``[^\\x20\\x09-\\x0D]+``, and per document the number of its first word (n + 1 values)."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    full = offsets[:-1] < offsets[1:]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit code for each word."""
    table = _table(1)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # bytes become codes piece by piece
        upto = max(at + 1, int(np.searchsorted(starts, starts[at] + PIECE)))
        low, high = starts[at], ends[upto - 1]
        out[at:upto] = span_hashes(table[data[low:high]], starts[at:upto] - low, ends[at:upto] - low, 1)
        at = upto
    return out


def gram_hashes(data: np.ndarray, length: int, seed: int = 5) -> np.ndarray:
    """The hash of every run of ``length`` consecutive bytes."""
    n = max(0, len(data) - length + 1)
    table, out = _table(seed), np.empty(n, np.uint64)
    for low in range(0, n, PIECE):
        high = min(n, low + PIECE)
        starts = np.arange(high - low)
        out[low:high] = span_hashes(table[data[low : high + length - 1]], starts, starts + length, seed)
    return out


def window_starts(first_word: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the words at which a run of ``width`` words of one document starts."""
    counts = np.maximum(np.diff(first_word) - width + 1, 0)
    return np.repeat(first_word[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    steps = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(steps[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true places."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def doc_slices(offsets: np.ndarray, most: int = 1 << 19):
    """Ranges of whole documents of about ``most`` bytes each; a longer document stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(upto, n)
        at = min(upto, n)
