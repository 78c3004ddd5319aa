"""Word shingles as 64-bit hashes, a column of texts at a time (numpy inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 2_000_000        # texts are hashed in runs of about this many bytes

_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_PLACE = mix(np.arange(1, 65, dtype=np.uint64) * _U(0xD1342543DE82EF95)) | _U(1)   # one odd factor per word of a shingle
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.r_[_U(1), np.full(max(n, 256), _U(0x5851F42D4C957F2D))].astype(np.uint64))
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of ASCII-lower-cased ``data``."""
    folded = _FOLD[np.frombuffer(data, np.uint8)]
    inside = ~_SPACE[folded]
    edges = np.diff(np.r_[False, inside, False].view(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    terms = _BYTE[folded[inside]] * _power_table(int(lengths.max()))[place]
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64)), starts


def _chunks(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    chunk, size = [], 0
    for t in texts:
        t = t or b""
        if chunk and size + len(t) > CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
        chunk.append(t)
        size += len(t) + 1
    if chunk:
        yield chunk


def shingle_sets(texts: list[bytes | None], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct ``width``-word shingle hashes per text; fewer words: all of them as one; none: empty."""
    for chunk in _chunks(texts):
        words, starts = word_hashes(b"\n".join(chunk))
        sizes = np.array([len(t) + 1 for t in chunk])
        bounds = np.searchsorted(starts, np.r_[0, np.cumsum(sizes)])
        rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            rolled += words[k:k + len(rolled)] * _PLACE[k]
        rolled = mix(rolled)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= width:
                yield np.unique(rolled[a:b - width + 1])
            elif b > a:
                yield mix((words[a:b] * _PLACE[:b - a]).sum(keepdims=True, dtype=np.uint64) + _U(b - a))
            else:
                yield np.empty(0, np.uint64)
