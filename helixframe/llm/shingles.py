"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def words(text: str) -> list[bytes]:
    """A-Z in lower case, then what lies between blanks and the control characters 9 to 13."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; the whole sequence as one if it is shorter; empty without words."""
    if not text:
        return np.empty(0, np.uint64)
    own = words(text)
    if not own:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in own], np.uint64)
    n = max(1, len(h) - width + 1)
    used = min(width, len(h))
    total = np.full(n, used, np.uint64)
    for k in range(used):
        total = mix(total + h[k : k + n] * np.uint64(2 * k + 3))
    return np.unique(total)
