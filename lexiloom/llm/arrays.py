"""Vectorised word and window hashes over batches of texts (numpy inside Spark tasks)."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words are runs of bytes outside space and \\t \\n \\v \\f \\r, which UTF-8 never uses inside a character.
_SPACE = bytes(c in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D) for c in range(256))
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes hashed at a time; a block ends at white space, so only a longer single word exceeds it.
BLOCK = 1 << 18
#: Windows hashed at a time, so that the arrays stay in the cache.
STEP = 1 << 14
#: Words of more bytes are hashed one at a time.
LONG = 64
#: Bits of the first n bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Odd multipliers and seeds of the two independent hashes.
_KEYS = tuple(tuple(np.uint64(x) for x in key) for key in ((0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15), (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93)))


def mix(h: np.ndarray, which: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    first, second, _ = _KEYS[which]
    h = h ^ (h >> np.uint64(30))
    h *= first
    h ^= h >> np.uint64(27)
    h *= second
    h ^= h >> np.uint64(31)
    return h


def _join(a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
    """Hashes of two neighbours' hashes; for a fixed ``a`` it is one to one in ``b``."""
    first, second, seed = _KEYS[which]
    h = a * seed
    h ^= h >> np.uint64(29)
    h += b
    h *= first
    h ^= h >> np.uint64(32)
    h *= second
    h ^= h >> np.uint64(29)
    return h


def _blocks(raw: bytes):
    start = 0
    while len(raw) - start > BLOCK:
        found = _GAP.search(raw, start + BLOCK)
        if not found:
            break
        yield start, raw[start : found.end()]
        start = found.end()
    yield start, raw[start:]


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words' starts and ends."""
    space = np.frombuffer(b"\1" + raw.translate(_SPACE) + b"\1", dtype=np.int8)
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(raw: bytes, seeds: int = 1) -> tuple[np.ndarray, ...]:
    """Starts and ends of the words of ``raw``, and ``seeds`` (1 or 2) independent 64-bit hashes.

    A word is read eight bytes at a time; every step is one to one in the bytes read and nonlinear in
    what came before, so no pattern of letters makes two words collide by construction.
    """
    parts = []
    for offset, block in _blocks(raw):
        starts, ends = word_spans(block)
        length = ends - starts
        lanes = np.ndarray(len(block) + 1, dtype="<u8", buffer=block + bytes(8), strides=(1,))
        first = lanes[starts] & _FIRST[np.minimum(length, 8)]
        out = [mix(first ^ length.astype(np.uint64) * _KEYS[k][2], k) for k in range(seeds)]
        more, at = np.flatnonzero((length > 8) & (length <= LONG)), 8
        while len(more):
            lane = lanes[starts[more] + at] & _FIRST[np.minimum(length[more] - at, 8)]
            for k in range(seeds):
                out[k][more] = _join(out[k][more], lane, k)
            at += 8
            more = more[length[more] > at]
        for i in np.flatnonzero(length > LONG).tolist():
            for k in range(seeds):
                out[k][i] = xxhash.xxh3_64_intdigest(block[starts[i] : ends[i]], k)
        parts.append((starts + offset, ends + offset, *out))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]


def window_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """The 64-bit hash of every run of ``size`` word hashes, from hashes of runs of 1, 2, 4, ... words."""
    out = np.empty(max(0, len(words) - size + 1), dtype=np.uint64)
    for at in range(0, len(out), STEP):
        out[at : at + STEP] = _windows(words[at : at + STEP + size - 1], size, which)
    return out


def _windows(words: np.ndarray, size: int, which: int) -> np.ndarray:
    n = len(words) - size + 1
    run, span, taken, out = words, 1, 0, None
    while True:
        if size & span:
            part = run[taken : taken + n]
            out = part if out is None else _join(out, part, which)
            taken += span
        if taken == size:
            return out
        run = _join(run[:-span], run[span:], which)
        span *= 2
