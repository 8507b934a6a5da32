"""64-bit hashes of words, shingles and byte runs of many texts at once."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_rng = np.random.default_rng(20240229)
#: A random odd number for each byte value.
BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SOLID = bytes(b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256))
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: The first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

_powers: list[np.ndarray] = []


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < size:
        size = max(size, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = []
        for base in (_BASE, inverse):
            steps = np.full(size, np.uint64(base & _MASK))
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0][:size], _powers[1][:size]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last byte of each run without ``[\\x20\\x09-\\x0D]``."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = np.frombuffer(data.tobytes().translate(_SOLID), bool)
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]


def span_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range; equal bytes give equal hashes wherever they stand."""
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[data] * up[: len(data)])])
    return mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """As ``span_hashes``, for ranges that don't overlap: work and memory follow their number, not the bytes.

    A range is read eight bytes at a time; what stands behind the first eight is summed by place.
    """
    size = end - first
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = mix(eights[first] & _FIRST[np.minimum(size, 8)])
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3
        start = np.cumsum(more) - more
        nth = np.arange(1, more.sum() + 1) - np.repeat(start, more)
        at = np.repeat(first[long], more) + 8 * nth
        part = eights[at] & _FIRST[np.minimum(np.repeat(end[long], more) - at, 8)]
        out[long] += np.add.reduceat(mix(part + nth.astype(np.uint64) * np.uint64(_BASE)), start)
    return mix(out + size.astype(np.uint64))


def words(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row and the number of words of each text.

    Words are runs of ``[^\\x20\\x09-\\x0D]``; A-Z are lower-cased first.
    """
    encoded = [(t or "").encode() for t in texts]
    joined = b"\n".join(encoded)
    data = np.frombuffer(joined.translate(_LOWER) if lower else joined, np.uint8)
    first, end = word_bounds(data)
    ends = np.cumsum([len(e) + 1 for e in encoded])
    counts = np.bincount(np.searchsorted(ends, first, side="right"), minlength=len(texts)) if len(first) else np.zeros(len(texts), int)
    return word_hashes(data, first, end), counts


def combined(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive hashes."""
    n = max(0, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * _PLACES[k % 64]
    return mix(total + np.uint64(size))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (as signed integers) of each text.

    A text with fewer than ``size`` words has its whole sequence as one shingle;
    a text without words has none.
    """
    hashes, counts = words(texts)
    whole = combined(hashes, size)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            own = whole[at : at + n - size + 1]
        elif n:
            own = combined(hashes[at : at + n], n)
        else:
            own = whole[:0]
        out.append(np.unique(own.view(np.int64)))
        at += n
    return out
