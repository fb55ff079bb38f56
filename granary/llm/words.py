"""Words and word shingles of many texts at once, as arrays of 64-bit codes.

A word is a longest run of ASCII letters, ASCII digits and non-ASCII characters.
ASCII and Latin-1 capitals count as small letters. A word's code is a polynomial
in its UTF-8 bytes modulo 2**64, mixed; equal words have equal codes, and two
different words share one with a probability of about 2**-64.
"""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
BASE = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


POWERS = powers(4096)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered(data: np.ndarray) -> np.ndarray:
    """Small letters for ASCII and Latin-1 capitals of UTF-8 bytes."""
    low = LOWER[data]
    if low.size > 1:
        after = low[1:]
        capital = (low[:-1] == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)
        after[capital] += 32
    return low


def codes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word codes, bounds of each text's words) of texts that lie end to end."""
    low = lowered(data)
    inside = IN_WORD[low]
    first = np.zeros(low.size + 1, bool)
    first[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    starts = np.flatnonzero(begins)
    word_bounds = np.searchsorted(starts, bounds)
    if not starts.size:
        return np.zeros(0, np.uint64), word_bounds
    letters = low[inside]
    cut = np.flatnonzero(begins[inside])
    length = np.diff(np.append(cut, letters.size))
    place = np.arange(letters.size) - np.repeat(cut, length)
    by = POWERS if (longest := int(length.max())) <= POWERS.size else powers(longest)
    return mix(np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * by[place], cut)), word_bounds


def heads(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first eight bytes of each word as a number, zeros after a shorter word; bounds of each text's words)."""
    low = lowered(data)
    inside = np.append(IN_WORD[low], False)
    first = np.zeros(low.size + 1, bool)
    first[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    starts = np.flatnonzero(begins)
    out, going = np.zeros(starts.size, np.uint64), np.ones(starts.size, bool)
    for j in range(8):
        at = np.minimum(starts + j, low.size)
        going &= inside[at]
        if j:
            going &= ~first[at]
        out = (out << np.uint64(8)) | np.where(going, low[np.minimum(at, low.size - 1)], 0).astype(np.uint64)
    return out, np.searchsorted(starts, bounds)


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all runs of k words inside a text, bounds of each text's runs)."""
    count = np.maximum(np.diff(bounds) - k + 1, 0)
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(out_bounds[-1]) + np.repeat(bounds[:-1] - out_bounds[:-1], count)
    total = np.zeros(at.size, np.uint64)
    for j in range(k):
        total = (total + words[at + j]) * BASE
    return mix(total), out_bounds


def occurrences(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many equal values stand before each one in its own text."""
    out = np.zeros(values.size, np.uint64)
    key = mix(values + mix(np.repeat(np.arange(bounds.size - 1, dtype=np.uint64), np.diff(bounds)) + np.uint64(1)))
    ordered = np.sort(key)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not again.size:
        return out
    place = np.minimum(np.searchsorted(again, key), again.size - 1)
    repeated = np.flatnonzero(again[place] == key)
    order = repeated[np.argsort(key[repeated], kind="stable")]
    new = np.append(True, key[order][1:] != key[order][:-1])
    began = np.maximum.accumulate(np.where(new, np.arange(order.size), 0))
    out[order] = (np.arange(order.size) - began).astype(np.uint64)
    return out


def texts_to_arrays(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
