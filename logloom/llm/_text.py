"""Whole texts as flat numpy arrays: words, word hashes and shingles of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BATCH_BYTES = 4 << 20
_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
#: ASCII white space of the contracts: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
WORD_BYTE = np.where(SPACE, U(0), BYTE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STEP = U(0x9E3779B97F4A7C15)
_powers = np.ones(1 << 12, U)


def powers(n: int) -> np.ndarray:
    """STEP ** i modulo 2**64."""
    global _powers
    if len(_powers) < n:
        size = 1 << int(n - 1).bit_length()
        _powers = np.concatenate([np.ones(1, U), np.full(size - 1, STEP, U)])
        _powers = np.multiply.accumulate(_powers)
    return _powers[:n]


powers(len(_powers) + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and n + 1 offsets; null counts as empty."""
    if texts.type in (pa.large_string(), pa.large_binary()):
        kind = np.int64
    else:
        kind = np.int32
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    _, offsets, data = texts.buffers()
    n = len(texts)
    at = np.frombuffer(offsets, kind, n + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return buf, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = flat(column(batch, name))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and n + 1 offsets of each text's words."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~SPACE[buf]
    head = np.ones(len(buf) + 1, bool)
    head[1:-1] = ~solid[:-1]
    head[at] = True  # a text's first byte starts a word, its last ends one
    starts = np.flatnonzero(solid & head[:-1])
    tail = np.empty(len(buf), bool)
    tail[:-1] = ~solid[1:]
    tail[-1] = True
    inner = at[(at > 0) & (at <= len(buf))] - 1
    tail[inner] = True
    ends = np.flatnonzero(solid & tail) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, U)
    lengths = ends - starts
    place = np.arange(len(buf), dtype=np.int32)
    first = np.zeros(len(buf), np.int32)
    span = np.diff(np.append(starts, len(buf)))
    first[starts[0] :] = np.repeat(starts.astype(np.int32), span)
    p = powers(int(span.max()) + int(starts[0]) + 1)
    h = np.add.reduceat(WORD_BYTE[buf] * p[place - first], starts)
    return mix(h ^ (lengths.astype(U) * U(0xD6E8FEB86659FD93)))


#: Odd factors for the places of a shingle.
PLACES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of every run of k words; runs that cross texts are the caller's to drop."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n] * PLACES[0]
    for j in range(1, k):
        out += h[j : n + j] * PLACES[j]
    return mix(out)


def owner(offsets: np.ndarray) -> np.ndarray:
    """For ragged offsets, the index of the row that holds each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
