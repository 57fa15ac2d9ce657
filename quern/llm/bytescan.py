"""Vectorised scans over the UTF-8 bytes of a batch of texts.

A batch is the concatenation of its texts plus offsets, which is how Arrow keeps a
string column, so nothing is copied or decoded row by row.  All hashes are 64-bit and
depend on the bytes alone, so every executor and every retry computes the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    n = len(column)
    buffers = column.buffers()
    if n == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    if buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, target: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that each has about ``target`` bytes of text.

    A single longer text stays whole, in a batch of its own.
    """
    for batch in batches:
        _, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + target, side="right")) - 1)
            yield batch.slice(at, min(to, batch.num_rows) - at)
            at = min(to, batch.num_rows)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.

    Returns their 64-bit hashes, the index of each word's text, and for each text the
    index of its first word (len + 1 entries).
    """
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = solid[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    at = np.flatnonzero(solid)
    counts = np.add.reduceat(solid, starts, dtype=np.int64)
    in_word = np.arange(len(at), dtype=np.int64)
    word_at = np.cumsum(counts) - counts
    in_word -= np.repeat(word_at, counts)
    powers = np.cumprod(np.full(int(counts.max()) + 1, _BASE, dtype=np.uint64))
    values = _BYTE[_LOWER[data[at]]]
    values *= powers[in_word]
    hashes = mix(np.add.reduceat(values, word_at) + counts.astype(np.uint64))
    bounds = np.searchsorted(starts, offsets)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(bounds))
    return hashes, owner, bounds


_PLACE = mix(np.arange(1, 65, dtype=np.uint64)) | _U(1)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingles; a shorter text is one shingle."""
    if len(hashes) >= k:
        rolled = np.zeros(len(hashes) - k + 1, np.uint64)
        for j in range(k):
            rolled += hashes[j : j + len(rolled)] * _PLACE[j]
        rolled = mix(rolled)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(rolled[a : b - k + 1])
            yield own[np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))]
        elif b > a:
            yield mix((hashes[a:b] * _PLACE[: b - a]).sum(keepdims=True) + _U(b - a))
        else:
            yield np.zeros(0, np.uint64)
