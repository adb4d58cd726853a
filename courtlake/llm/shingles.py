"""Sets of word shingles as 64-bit hashes, over whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .langid import text_bytes

N_WORDS = 5
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_BACK = pow(_BASE, -1, 1 << 64)
_COMBINE = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(N_WORDS)], np.uint64)
_CHUNK = 1 << 19
_powers = {_BASE: np.ones(1, np.uint64), _BACK: np.ones(1, np.uint64)}

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers; those that a chunk needs stay in memory, those of a longer text don't."""
    if len(_powers[base]) >= n:
        return _powers[base][:n]
    steps = np.full(max(n, _CHUNK), base, np.uint64)
    steps[0] = 1
    powers = np.cumprod(steps)
    if len(powers) == _CHUNK:
        _powers[base] = powers
    return powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each bit of a number over all of it."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each text and in all)."""
    b = _LOWER[data]
    word = ~_WHITE[data]
    before, after = np.empty_like(word), np.empty_like(word)
    before[0] = after[-1] = False
    before[1:], after[:-1] = word[:-1], word[1:]
    edges = at[(at > 0) & (at < len(data))]
    before[edges] = False
    after[edges - 1] = False
    s, e = np.nonzero(word & ~before)[0], np.nonzero(word & ~after)[0] + 1
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(b)), out=sums[1:])
    return mix((sums[e] - sums[s]) * _power(_BACK, len(b))[s] + (e - s).astype(np.uint64)), np.searchsorted(s, at)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Letters A to Z are lower-cased and words are runs of other bytes than white space. A text of fewer than N_WORDS
    words is one shingle; without words it has none.
    """
    data, at = text_bytes(texts)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + _CHUNK, "right")) - 1)
        if at[j] == at[i]:
            for _ in range(i, j):
                yield np.zeros(0, np.uint64)
        else:
            words, first = _word_hashes(data[at[i] : at[j]], at[i : j + 1] - at[i])
            n = max(len(words) - N_WORDS + 1, 0)
            grams = mix(sum((words[t : n + t] * _COMBINE[t] for t in range(N_WORDS)), np.zeros(n, np.uint64)))
            for s, e in zip(first[:-1], first[1:], strict=True):
                if e - s >= N_WORDS:
                    yield np.unique(grams[s : e - N_WORDS + 1])
                elif e > s:
                    yield mix(np.array([sum(int(words[s + t]) * int(_COMBINE[t]) for t in range(e - s)) + int(e - s) & _MASK], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)
        i = j
