"""Word hashing and bounded batches for tasks that read text through Arrow."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once inside a task; long documents are hashed piece by piece.
PIECE_BYTES = 1 << 19
BATCH_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _POWERS[size] = tuple(tables)
    return _POWERS[size]


def hash_piece(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a buffer in which single spaces separate them."""
    raw = np.frombuffer(buffer, np.uint8)
    cuts = np.flatnonzero(raw == 32)
    starts = np.concatenate(([0], cuts + 1))
    ends = np.concatenate((cuts, [raw.size]))
    power, inverse = _powers(raw.size + 1)
    sums = np.zeros(raw.size + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: raw.size], out=sums[1:])
    sizes = (ends - starts).astype(np.uint64)
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + sizes * np.uint64(0xD6E8FEB86659FD93)), starts, ends


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word: polynomial over its bytes, then mixed. Equal words have equal hashes anywhere."""
    if not words:
        return np.zeros(0, np.uint64)
    out, first, size = [], 0, 0
    for i, word in enumerate(words):
        size += len(word) + 1
        if size >= PIECE_BYTES:
            out.append(hash_piece(b" ".join(words[first : i + 1]))[0])
            first, size = i + 1, 0
    if first < len(words):
        out.append(hash_piece(b" ".join(words[first:]))[0])
    return out[0] if len(out) == 1 else np.concatenate(out)


def hash_shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; fewer words give the whole sequence, none give nothing."""
    if hashes.size == 0:
        return hashes
    span = min(width, hashes.size)
    n = hashes.size - span + 1
    total = np.zeros(n, np.uint64)
    for k in range(span):
        total = total * np.uint64(_BASE) + hashes[k : k + n]
    return mix64(total + np.uint64(span))


def hand_back() -> None:
    """Gives memory that this process has freed back to the system: workers and the driver live on for other stages."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of text each, and one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        sizes = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, before + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last



def hash_windows(raw: bytes, width: int) -> np.ndarray:
    """Hash of every run of ``width`` bytes, in pieces of bounded size."""
    out = []
    for first in range(0, max(1, len(raw) - width + 1), PIECE_BYTES):
        piece = np.frombuffer(raw[first : first + PIECE_BYTES + width - 1], np.uint8).astype(np.uint64)
        if piece.size < width:
            break
        power, inverse = _powers(piece.size + 1)
        sums = np.zeros(piece.size + 1, np.uint64)
        np.cumsum((piece + np.uint64(1)) * power[: piece.size], out=sums[1:])
        n = piece.size - width + 1
        out.append(mix64((sums[width:] - sums[:n]) * inverse[:n]))
    return np.concatenate([np.zeros(0, np.uint64), *out])
