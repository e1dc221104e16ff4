"""Hashed word n-grams of byte strings, many documents at a time."""

from __future__ import annotations

import functools

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20240101)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes that are hashed at a time.
CHUNK = 250_000
_BASE = int(_RANDOM.integers(1, 1 << 62)) * 8 + 5


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that lets every bit depend on every other."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.concatenate([np.ones(1, np.uint64), np.full(n, b % (1 << 64), np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, inverse))


def word_spans(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hash, begin and end of each word of the texts joined by blanks, and that string (A-Z lower-cased; ASCII white space divides). Works on CHUNK bytes at a time, whatever the length of a text."""
    joined = b" ".join(raws).lower() + b" "
    buf = np.frombuffer(joined, np.uint8)
    found, a = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    while a < len(buf):
        b, step = min(a + CHUNK, len(buf)), 4096
        while b < len(buf) and not _SPACE[buf[b - 1]]:  # not within a word
            ahead = _SPACE[buf[b : b + step]]
            b += int(ahead.argmax()) + 1 if ahead.any() else len(ahead)
        part = buf[a:b]
        edge = np.diff(_SPACE[part].astype(np.int8), prepend=1)
        first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = powers(1 << max(20, len(part).bit_length()))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * up[: len(part)], dtype=np.uint64)])
        found.append((mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64)), first + a, end + a))
        a = b
    return *(np.concatenate(x) for x in zip(*found, strict=True)), joined


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, text after text, and the words of each text."""
    hashes, first, _, _ = word_spans(raws)
    begins = np.cumsum([0, *(len(r) + 1 for r in raws)])
    return hashes, np.diff(np.searchsorted(first, begins))


def shingle_sets(raws: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-word shingles, sorted, text after text, and the size of each set. Fewer than n words count as one shingle."""
    words, counts = word_hashes(raws)
    doc = np.repeat(np.arange(len(raws)), counts)
    ends = np.cumsum(counts)
    left = ends[doc] - np.arange(len(words))  # words from here to the end
    h = np.zeros(len(words), np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for j in range(n):
        h += np.where(left > j, padded[j : j + len(words)] * _PLACE[j], np.uint64(0))
    whole = counts[doc] < n
    h = mix(h + np.where(whole, counts[doc], n).astype(np.uint64))
    take = (left >= n) | (whole & (left == counts[doc]))
    h, doc = h[take], doc[take]
    sizes = np.bincount(doc, minlength=len(raws))
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(raws))
