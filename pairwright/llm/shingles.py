"""Five-word shingles as sorted sets of 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np

from pairwright.llm.text import BoundedCache

WORDS = 5
CACHE_WORDS = 300_000

_FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


class Shingler:
    """Shingle sets of texts; word hashes are kept in a bounded cache."""

    def __init__(self) -> None:
        self.cache = BoundedCache(CACHE_WORDS)

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.cache.get, words))
        if None in found:
            missing = {word for word, value in zip(words, found, strict=True) if value is None}
            self.cache.room(len(missing))
            for word in missing:
                self.cache[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            found = [self.cache[word] if value is None else value for word, value in zip(words, found, strict=True)]
        return np.array(found, "u8")

    def sets(self, text: bytes | None) -> np.ndarray:
        """Distinct shingles, ascending. Fewer than five words are one shingle, no words none."""
        words = text.lower().split() if text else []
        if not words:
            return np.zeros(0, "u8")
        hashes = self._hashes(words)
        width = min(WORDS, len(hashes))
        size = len(hashes) - width + 1
        out = np.full(size, width, "u8")
        for i in range(width):
            out += hashes[i : i + size] * np.uint64(_FACTORS[i])
        # the sum is linear in the hashes; mix it so that its order is as good as random
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        return np.unique(out)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def node_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)
