"""Words of many texts at once, as numpy arrays over the UTF-8 bytes.

All separator classes used here are ASCII, so words can be cut on bytes. A word is hashed
to 64 bits; where a result must be exact, matches are confirmed on the words themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_VALUES = mix(np.arange(1, 257, dtype=_U) * _BASE)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: word bytes: all but blank and \x09-\x0D
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: word bytes after lower-casing A-Z: digits, a-z and everything beyond ASCII
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2^64, and of its inverse."""
    base = int(_BASE) | 1
    out = []
    for x in (base, pow(base, -1, 1 << 64)):
        powers = np.full(n, x, _U)
        powers[0] = 1
        out.append(np.cumprod(powers, dtype=_U))
    return out[0], out[1]


#: bytes hashed at a time
_SPAN = 1 << 18
_POWERS, _INVERSE = _powers(_SPAN)


@dataclass
class Words:
    """Words of a slice of texts. ``first[d]`` to ``first[d + 1]`` are those of text d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    text_at: np.ndarray
    hashes: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def room(self) -> np.ndarray:
        """For each word, how many words of its text begin here or later."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))

    def raw(self, a: int, b: int) -> bytes:
        """Words a to b, lower-cased, with single blanks between."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b]))


def cut(texts: list[str], word_bytes: np.ndarray, lower: bool = True, hashed: bool = True) -> Words:
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    text_at = np.concatenate([[0], np.cumsum(sizes)])
    inside = word_bytes[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    first = np.searchsorted(starts, text_at)
    data = _LOWER[raw] if lower else raw
    return Words(data, starts, ends, first, text_at, word_hashes(data, starts, ends) if hashed else None)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial of its bytes, from running sums over blocks of words.

    The sum of value x base^position over a word, divided by base^start, does not depend on
    where the word stands.
    """
    global _POWERS, _INVERSE
    out = np.empty(len(starts), _U)
    a = 0
    while a < len(starts):
        at = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, at + _SPAN, "right")))
        n = int(ends[b - 1] - at)
        if n > len(_POWERS):
            _POWERS, _INVERSE = _powers(2 * n)
        running = np.zeros(n + 1, _U)
        np.cumsum(_VALUES[data[at:at + n]] * _POWERS[:n], out=running[1:], dtype=_U)
        s, e = starts[a:b] - at, ends[a:b] - at
        out[a:b] = mix(((running[e] - running[s]) * _INVERSE[s]) ^ ((e - s).astype(_U) * _BASE))
        a = b
    return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions are missing."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    out = hashes[:n] * _BASE
    for j in range(1, k):
        out ^= out >> _U(29)
        out += hashes[j:n + j]
        out *= _BASE
    return mix(out)
