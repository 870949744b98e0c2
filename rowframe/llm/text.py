"""Vectorised word kernels over UTF-8 buffers, used inside Arrow batches.

A batch of documents is one byte buffer with offsets.  Words are found and hashed with a handful of numpy passes over
the buffer, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one pass of the kernels holds (a longer document is handled alone).
SLAB_BYTES = 1 << 20

_PRIME = 0x9E3779B97F4A7C15
_PRIME_INVERSE = pow(_PRIME, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

#: The bytes of [\x20\x09-\x0D]: what separates words kept "unchanged".
SPACE_BYTES = np.zeros(256, dtype=bool)
SPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, all other bytes unchanged.
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[0x41:0x5B] += 0x20

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(str(base))
    if table is None or len(table) < n:
        table = np.full(max(n, SLAB_BYTES + 1), base, dtype=np.uint64)
        table[0] = 1
        table = np.cumprod(table, dtype=np.uint64)
        _powers[str(base)] = table
    return table[:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary() if pa.types.is_large_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slabs(offsets: np.ndarray, limit: int = SLAB_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of documents of at most ``limit`` bytes, or of one longer document."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of every maximal run of non-separator bytes."""
    inside = ~separators[data]
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over the byte codes, by differences of one prefix sum."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[data] * _power_table(_PRIME, len(data)), out=total[1:])
    value = (total[ends] - total[starts]) * _power_table(_PRIME_INVERSE, len(data) + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive entries (len - width + 1 of them)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1)), dtype=np.uint64)
    for k in range(width):
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out += words[k : k + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def windows_in_one_document(docs: np.ndarray, width: int) -> np.ndarray:
    """Whether the window of ``width`` words at each start lies in one document; docs: sorted document of each word."""
    n = len(docs) - width + 1
    return docs[:n] == docs[width - 1 :] if n > 0 else np.zeros(0, bool)
