"""Vectorised word hashing for Arrow batches.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  Words of a whole
chunk of texts are found and hashed with a handful of numpy passes, so that no
Python object is made per word.  Hashes depend on the words' bytes alone, never
on the chunk they were read in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are hashed at once; a longer text makes a longer chunk.
CHUNK_BYTES = 512 << 10

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 4096)
        with np.errstate(over="ignore"):
            have = np.full(size, base, dtype=U64)
            have[0] = 1
            have = np.multiply.accumulate(have)
        if size > 4 * CHUNK_BYTES:  # a very long text: not kept
            return have[:n]
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def chunks(texts: list[bytes | None], size: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) of runs of about ``size`` bytes; None counts as empty."""
    first, held, n = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or b"")
        n += len(held[-1]) + 1
        if n >= size:
            yield first, held
            first, held, n = i + 1, [], 0
    if held:
        yield first, held


def hash_words(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds): words of text i are ``[bounds[i], bounds[i+1])``.

    ``lower`` maps A-Z to a-z first and leaves every other character alone.
    """
    data = b"\n".join(texts) + b"\n"
    if lower:
        data = data.lower()  # bytes.lower() knows ASCII only
    raw = np.frombuffer(data, dtype=np.uint8)
    gap = _SPACE[raw]
    before = np.empty_like(gap)
    before[0], before[1:] = True, gap[:-1]
    start = np.flatnonzero(before & ~gap)
    end = np.flatnonzero(gap & ~before)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    edges = np.concatenate(([0], np.cumsum(lengths)))
    bounds = np.searchsorted(start, edges)
    total = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum(_BYTE[raw] * _power(_BASE, len(raw)), out=total[1:])
    h = (total[end] - total[start]) * _power(_BASE_INV, len(raw))[start]
    return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)), bounds


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; the last k-1 places have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    for j in range(k):
        out *= U64(0x2545F4914F6CDD1D)
        out += words[j : j + n]
    return mix(out)


def sequence(words: np.ndarray) -> int:
    """Hash of a whole word sequence that is shorter than a shingle."""
    out = U64(len(words) * 0x9E3779B1)
    with np.errstate(over="ignore"):
        for w in words:
            out = mix(np.array([out * U64(0x2545F4914F6CDD1D) + w], dtype=U64))[0]
    return int(out)


def shingle_sets(texts: list[bytes | None], k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each text, A-Z lower-cased.

    A text of 1 to k-1 words has its whole sequence as one; a text without
    words has none.
    """
    for _, part in chunks(texts):
        words, bounds = hash_words(part, lower=True)
        runs = rolling(words, k)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            elif b > a:
                yield np.array([sequence(words[a:b])], dtype=U64)
            else:
                yield np.empty(0, dtype=U64)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()
