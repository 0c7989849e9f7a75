"""Words, word shingles and their multisets as arrays of 64-bit hashes.

A word is a maximal run of ASCII letters, ASCII digits or non-ASCII characters
of the lower-cased text. All steps are vectorised over many texts at once.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_P_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = True
_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 step), element by element."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(0, np.uint64), np.ones(0, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _P), np.full(size, _P_INV)
        up[0] = down[0] = 1
        _powers = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and where each text's words begin (one entry more than texts)."""
    parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    inside = _WORD[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(raw) and inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + _U(1)) * up[: len(raw)], out=total[1:])
    words = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, begins)


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, text by text, sorted within each text; and where each text's begin.

    A text of fewer than k words, but not none, has one shingle of all its words.
    """
    counts = np.diff(at)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    out_at = np.concatenate(([0], np.cumsum(made)))
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    source = np.arange(out_at[-1]) + np.repeat(at[:-1] - out_at[:-1], made)
    left = np.repeat(at[1:], made) - source
    h = np.zeros(len(source), np.uint64)
    for i in range(k):
        h = mix((h + padded[source + i] * (left > i)) * _P + _U(i + 1))
    for a, b in zip(out_at[:-1].tolist(), out_at[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    return h, out_at


def occurrences(sorted_hashes: np.ndarray) -> np.ndarray:
    """A multiset as a set: the i-th copy of an element becomes an element of its own; sorted."""
    n = len(sorted_hashes)
    if not n:
        return sorted_hashes
    first = np.concatenate(([True], sorted_hashes[1:] != sorted_hashes[:-1]))
    if first.all():
        return sorted_hashes
    rank = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    return np.sort(np.where(rank > 0, mix(sorted_hashes + rank.astype(np.uint64) * _P), sorted_hashes))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets given by `occurrences`; 0 for two empty ones."""
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int((b[at] == a).sum())
    return common / (len(a) + len(b) - common)


def content_keys(texts: list[str | None], words: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """Equal for texts with the same words in the same order; texts without words must be equal in full; null for null."""
    keys: list[bytes | None] = []
    for text, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist()):
        if text is None:
            keys.append(None)
        else:
            keys.append(hashlib.blake2b(words[a:b].tobytes() if b > a else b"\0" + text.encode("utf-8", "replace"), digest_size=16).digest())
    return keys
