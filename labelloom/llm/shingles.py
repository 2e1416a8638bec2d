"""Word shingles as 64-bit hashes, computed text by text inside a task."""

from __future__ import annotations

import hashlib

import numpy as np

#: Words whose hashes a process remembers.
MAX_WORDS = 200_000
_known: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that changes about half of them for any change of the input."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hash(word: bytes) -> int:
    found = _known.get(word)
    if found is None:
        if len(_known) >= MAX_WORDS:
            _known.clear()
        found = _known[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return found


def words(text: str) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09-0x0D), with A-Z lower-cased."""
    return text.encode().lower().split()


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``width`` words; fewer words are one shingle, none give an empty set."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(_hash, found), np.uint64, len(found))
    width = min(width, len(codes))
    n = len(codes) - width + 1
    hashes = np.full(n, width, np.uint64)
    for i in range(width):
        hashes = mixed(hashes * np.uint64(3) + codes[i : i + n])
    return np.unique(hashes)
