"""Sets of word shingles as 64-bit hashes, and SuperMinHash signatures of them, by array operations."""

from __future__ import annotations

import numpy as np

from .words import hash_runs, ragged

WORDS = 5
#: Shingles that meet the slots of their signatures at once, each with an order of all slots.
ELEMENTS_AT_ONCE = 1 << 16
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_BLANKS = np.zeros(256, bool)
_BLANKS[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def seeded(k: int) -> np.uint64:
    return mix(np.array([k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]


def shingle_sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's word shingles, one text after another, and how many each text has.

    Words are runs of anything but the six ASCII blanks, A-Z in lower case. A text with fewer words has its whole sequence as the
    only shingle, one without words none.
    """
    raws = [t.encode("utf-8") for t in texts]
    chars = _LOWER[np.frombuffer(b"".join(raws), np.uint8)]
    ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))
    blank = _BLANKS[chars]
    first = np.zeros(len(chars) + 1, bool)
    first[ends[ends < len(chars)]] = True
    first[0] = True
    first = first[: len(chars)]
    start = ~blank
    start[1:] &= blank[:-1] | first[1:]
    stop = ~blank
    stop[:-1] &= blank[1:] | first[1:]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    last = np.searchsorted(starts, ends, "left")
    begin = np.concatenate([[0], last[:-1]]) if len(last) else last
    n_words = last - begin
    word = hash_runs(chars, starts, stops)
    with np.errstate(over="ignore"):
        n_windows = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
        at = ragged(begin, n_windows)
        size = np.repeat(np.minimum(n_words, words), n_windows)
        total = size.astype(np.uint64)
        for k in range(words):
            inside = np.minimum(at + k, max(len(word) - 1, 0))
            total = total + np.where(k < size, word[inside] if len(word) else np.uint64(0), np.uint64(0)) * seeded(k + 1)
    hashes = mix(total)
    edges = np.cumsum(n_windows)
    a = 0
    for b in edges.tolist():
        if b - a > 1:
            hashes[a:b].sort()
        a = b
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    heads = (edges - n_windows)[n_windows > 0]
    fresh[heads] = True
    counts = np.zeros(len(texts), np.int64)
    if len(hashes):
        counts[n_windows > 0] = np.add.reduceat(fresh.astype(np.int64), heads)
    return hashes[fresh], counts


def set_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two numbers of 64 bits for each set that are equal for equal sets; an empty set has zeros."""
    out = np.zeros((2, len(counts)), np.uint64)
    full = counts > 0
    heads = (np.cumsum(counts) - counts)[full]
    if len(heads):
        for k in range(2):
            with np.errstate(over="ignore"):
                out[k, full] = mix(np.add.reduceat(mix(hashes ^ seeded(11 + k)), heads))
    return out.view(np.int64)


def super_minhash(hashes: np.ndarray, counts: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash signature of each set, as a row of numbers; an empty set's are all the largest number.

    Each element meets the slots in a random order of its own, its rank at the j-th slot lying between j and j + 1. Slots keep the
    lowest rank, so a signature is also the lowest ranks of those of a set's parts: whole sets are taken together up to
    ELEMENTS_AT_ONCE elements, and a larger set in parts.
    """
    signature = np.full((len(counts), slots), _EMPTY)
    ends, lo = np.cumsum(counts), 0
    while lo < len(hashes):
        first, last = (int(x) for x in np.searchsorted(ends, [lo, lo + ELEMENTS_AT_ONCE], "right"))
        hi = int(ends[last - 1]) if last > first else lo + ELEMENTS_AT_ONCE
        last = max(last, first + 1)
        own = signature[first:last]
        np.minimum(own, _lowest_ranks(hashes[lo:hi], np.diff(np.minimum(ends[first:last], hi), prepend=lo), slots), out=own)
        lo = hi
    return signature


def _lowest_ranks(hashes: np.ndarray, counts: np.ndarray, slots: int) -> np.ndarray:
    """All elements take their j-th slot before any takes the next, so a slot once filled is final, and a set whose slots are all
    filled stops: most sets after one or two of the steps."""
    sets = np.repeat(np.arange(len(counts)), counts)
    signature = np.full(len(counts) * slots, _EMPTY)
    order = None
    element, h = np.arange(len(hashes)), hashes
    for j in range(slots):
        if not len(h):
            break
        draw = mix(h ^ seeded(101 + j))
        pick = j + ((draw >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        rank = (np.uint64(j) << np.uint64(48)) | (mix(draw) >> np.uint64(16))
        if order is None:
            slot = pick
        else:
            row = np.arange(len(h))
            slot = order[row, pick].astype(np.int64)
            order[row, pick] = order[row, j]
        owner = sets[element]
        target = owner * slots + slot
        np.minimum.at(signature, target, rank)
        going = (signature.reshape(-1, slots) == _EMPTY).any(axis=1)[owner]
        if order is None:
            element, h, pick = element[going], h[going], pick[going]
            order = np.tile(np.arange(slots, dtype=np.min_scalar_type(slots - 1)), (len(h), 1))
            order[np.arange(len(h)), pick] = 0
        else:
            element, h, order = element[going], h[going], order[going]
    return signature.reshape(-1, slots)
