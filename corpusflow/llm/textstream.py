"""Word and shingle hashes of many texts at once, as NumPy arrays.

Words are maximal runs outside ``\\x20 \\x09-\\x0D``. A word's hash is a polynomial over mixed
byte values, read off prefix sums, so no Python loop touches a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE_LOWER = _VALUE[_LOWER]


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        table = np.full(size, _ODD if kind == "up" else _ODD_INVERSE, np.uint64)
        table[0] = 1
        _powers[kind] = np.cumprod(table, dtype=np.uint64)
    return _powers[kind][:n]


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of whole texts of about ``limit`` bytes: (first, past last, encoded texts). A longer text is a run of its own."""
    start, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(b) > limit:
            yield start, i, held
            start, held, size = i, [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield start, len(texts), held


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, number of words of each text)."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~SPACE[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((_VALUE_LOWER if lower else _VALUE)[buffer] * _power("up", len(buffer)), out=sums[1:])
    hashed = mix((sums[ends] - sums[starts]) * _power("down", len(buffer))[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return hashed, np.diff(np.concatenate(([0], np.searchsorted(starts, bounds))))


_STEP = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles, A-Z lower-cased; a shorter text is one shingle, an empty one has none."""
    words, counts = word_hashes(texts, lower=True)
    out, at = [], 0
    if len(words) >= width:
        rolled = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            rolled += words[k : len(words) - width + 1 + k] * _STEP[k]
        rolled = mix(rolled)
    for n in counts:
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            out.append(mix(np.array([(words[at : at + n] * _STEP[:n]).sum() + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
