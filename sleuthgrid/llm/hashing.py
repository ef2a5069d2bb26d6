"""Vectorised 64-bit hashes of words and word windows.

All arithmetic is modulo 2**64. A word is a run of bytes other than space and
tab to carriage return; these bytes never occur inside a UTF-8 sequence.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def odd_powers(n: int, seed: int) -> np.ndarray:
    """1, m, m**2 ... for an odd multiplier drawn from seed."""
    if n <= 64:
        if seed not in _POWERS:
            _POWERS[seed] = _powers(64, seed)
        return _POWERS[seed][: max(1, n)]
    return _powers(n, seed)


def _powers(n: int, seed: int) -> np.ndarray:
    m = int(mix(np.array([seed * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1], np.uint64))[0]) | 1
    out = np.full(max(1, n), m, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word."""
    between = np.flatnonzero(_SEPARATOR[np.frombuffer(data, np.uint8)])
    before, after = np.append(-1, between) + 1, np.append(between, len(data))
    some = before < after
    return before[some], after[some]


#: Places of a word that have random numbers of their own in a table; later ones mix in how often they went round it.
PLACES = 32
_TABLES: dict[int, np.ndarray] = {}


def _place_table(seed: int) -> np.ndarray:
    """A random number for each place in a word and byte; 0 for those between words."""
    if seed not in _TABLES:
        table = mix(mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed)).reshape(PLACES, 256)
        table[:, _SEPARATOR] = 0
        _TABLES[seed] = table.reshape(-1)
    return _TABLES[seed]


def word_hashes(data: bytes, seed: int = 1, bounds: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A hash of each word, in order, by tabulation; long texts are worked in blocks. bounds: those of the words, if known."""
    if bounds is not None and len(data) <= BLOCK:
        return _hashes(data, *bounds, _place_table(seed))
    out, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + BLOCK)
        while end < n and not _SEPARATOR[data[end]]:
            end += 1
        part = data[at:end]
        at = end
        out.append(_hashes(part, *word_bounds(part), _place_table(seed)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _hashes(part: bytes, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.empty(0, np.uint64)
    raw = np.frombuffer(part, np.uint8)[starts[0] :]
    spans = np.diff(np.append(starts - starts[0], len(raw)))
    place = np.arange(len(raw), dtype=np.int64) - np.repeat(starts - starts[0], spans)
    values = table[(place % PLACES << 8) | raw]
    if (ends - starts).max() > PLACES:
        far = np.flatnonzero((place >= PLACES) & ~_SEPARATOR[raw])
        values[far] = mix(values[far] + (place[far] // PLACES).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return mix(np.add.reduceat(values, starts - starts[0]) + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int, seed: int = 11) -> np.ndarray:
    """A hash of each run of size consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, p in enumerate(odd_powers(size, seed)):
        total += words[j : j + n] * p
    return mix(total)
