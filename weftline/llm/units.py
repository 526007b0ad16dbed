"""Texts as arrays of units (bytes or words), their hashes, and window minima, all in numpy.

Everything works on a batch of texts laid end to end in one byte buffer, so the
cost per text is a few array passes and not a Python loop.
"""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_STEP = U64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches the high bits."""
    h = h ^ (h >> U64(32))
    h *= _STEP
    h ^= h >> U64(29)
    h *= _ODD
    h ^= h >> U64(32)
    return h


#: A pseudo-random word for every byte value, made by rule.
BYTE_WORDS = mix(np.arange(1, 257, dtype=U64) * _ODD)
#: White space of the word rule: the blank and 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Characters that separate the words of the alphanumeric rule: all of ASCII but 0-9 and a-z (after lower-casing).
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:128] = True
NON_ALNUM[48:58] = False
NON_ALNUM[97:123] = False
#: A-Z to a-z, everything else as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least n of each."""
    if "p" not in _powers or len(_powers["p"]) < n:
        n = max(n, 1 << 20)
        base = 0xD1342543DE82EF95
        inverse = pow(base, -1, 1 << 64)
        for k, b in (("p", base), ("q", inverse)):
            a = np.full(n, b, U64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["p"], _powers["q"]


def lay(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts end to end, and where each begins (one more entry than texts)."""
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    return np.frombuffer(b"".join(texts), np.uint8), ends


def byte_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf, ends = lay(texts)
    return BYTE_WORDS[buf], ends


def word_bounds(texts: list[bytes], gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer (a separator after every text), starts and ends of words, and the first word of each text."""
    buf, _ = lay([x for t in texts for x in (t, b" ")])
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=ends[1:])
    word = np.empty(len(buf) + 1, np.int8)
    word[0] = 0
    np.logical_not(gap[buf], out=word[1:].view(bool))
    turn = np.diff(word)
    starts, stops = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    return buf, starts, stops, np.searchsorted(starts, ends)


def word_hashes(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A polynomial hash of every word from prefix sums."""
    if not len(starts):
        return np.zeros(0, U64)
    p, q = _power(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U64)
    np.cumsum(BYTE_WORDS[buf] * p[: len(buf)], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * q[starts])


def word_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf, starts, stops, first = word_bounds(texts, SPACE)
    return word_hashes(buf, starts, stops), first


def gram_hashes(u: np.ndarray, k: int, base: int = 0xA0761D6478BD642F) -> np.ndarray:
    """A hash of every k consecutive units (63 bits), by doubling; shorter by k - 1 than u."""
    if len(u) < k:
        return np.zeros(0, U64)
    out, have, power, at = None, 0, base, u
    width, bits = 1, k
    while bits:
        if bits & 1:
            if out is None:
                out, have = at, width
            else:
                n = len(u) - have - width + 1
                out = out[:n] * U64(power) + at[have : have + n]
                have += width
        bits >>= 1
        if bits:
            n = len(at) - width
            at = at[:n] * U64(power) + at[width : width + n]
            power = power * power % (1 << 64)
            width *= 2
    return mix(out) >> U64(1)


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values, by doubling."""
    if len(h) < w:
        return h[:0]
    have = 1
    while have * 2 <= w:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (w - have)], h[w - have :]) if w > have else h


def ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, end to end."""
    if not len(counts):
        return np.zeros(0, np.int64)
    at = np.cumsum(counts)
    return np.arange(at[-1]) - np.repeat(at - counts, counts)


def subtag(text: bytes) -> int:
    """Tells rows apart that share a doc_id but not a text (64 bits)."""
    return xxhash.xxh64_intdigest(text)
