"""Word shingles of whole texts as sorted sets of 64-bit hashes, with numpy inside tasks."""

from __future__ import annotations

import numpy as np

# A-Z to a-z; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
PIECE = 1 << 20  # words hashed at once, so that a very long text needs little memory

_random = np.random.default_rng(20_240_601)
_BYTES = _random.integers(1, 2**63, 256, dtype=np.uint64)
_BYTES[32] = 0  # the space between two words adds nothing
_PLACES = _random.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    """The powers of an odd constant modulo 2**64, at least ``n`` of them."""
    global _powers
    if len(_powers) < n:
        factors = np.full(max(n, 2 * len(_powers)), np.uint64(0x9E3779B97F4A7C15))
        factors[0] = 1
        _powers = np.multiply.accumulate(factors)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all its bits (the finisher of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words between white space (space, tab to carriage return) with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word."""
    parts = []
    for at in range(0, len(words), PIECE):
        piece = words[at:at + PIECE]
        data = np.frombuffer(b" ".join(piece), np.uint8)
        ends = np.flatnonzero(data == 32)
        starts = np.concatenate(([0], ends + 1))
        lengths = np.diff(np.concatenate((starts, [len(data) + 1])))
        inside = np.arange(len(data)) - np.repeat(starts, lengths)[:len(data)]
        values = _BYTES[data] * _power_table(int(lengths.max()))[inside]
        parts.append(mix(np.add.reduceat(values, starts)))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingle_hashes(words: list[bytes], width: int = 5) -> np.ndarray:
    """The hash of each run of ``width`` words in order; fewer words are one run."""
    h = hash_words(words)
    if not len(h):
        return np.empty(0, np.int64)
    width_here = min(width, len(h))
    total = np.full(len(h) - width_here + 1, np.uint64(width_here))
    for k in range(width_here):
        total = total + h[k:len(h) - width_here + 1 + k] * _PLACES[k]
    return mix(total).view(np.int64)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending; empty without words."""
    return np.unique(shingle_hashes(words_of(text), width))
