"""Runs of signs in texts as byte arrays: which text each run is of, where it starts and ends."""

from __future__ import annotations

import numpy as np

from .words import KnownWords, Words, hash_runs

#: ASCII letters, digits and all bytes of characters beyond ASCII.
TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[48:58] = TERM_BYTES[65:91] = TERM_BYTES[97:123] = TERM_BYTES[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Runs:
    """The maximal runs of some bytes in the UTF-8 of texts, A-Z in lower case; none crosses texts."""

    def __init__(self, texts: list[str], inside: np.ndarray = TERM_BYTES):
        raws = [t.encode("utf-8") for t in texts]
        self.chars = _LOWER[np.frombuffer(b"".join(raws), np.uint8)]
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        ends = np.cumsum(sizes)
        flags = inside[self.chars]
        first = np.zeros(len(self.chars), bool)
        first[(ends - sizes)[sizes > 0]] = True
        start, stop = flags.copy(), flags.copy()
        start[1:] &= ~flags[:-1] | first[1:]
        stop[:-1] &= ~flags[1:] | first[1:]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
        self.text = np.searchsorted(ends, self.starts, "right")
        self.counts = np.bincount(self.text, minlength=len(texts))

    def hashes(self) -> np.ndarray:
        return hash_runs(self.chars, self.starts, self.ends)


class Terms:
    """Distinct terms, numbered; found by hash and told apart by their bytes."""

    def __init__(self, runs: Runs):
        """The distinct runs, in the order in which they are met."""
        self.place: dict[bytes, int] = {}
        raw = runs.chars.tobytes()
        self.number = np.fromiter(
            (self.place.setdefault(raw[s:e], len(self.place)) for s, e in zip(runs.starts.tolist(), runs.ends.tolist(), strict=True)), np.int64, len(runs.starts))
        terms = list(self.place)
        own = object.__new__(Words)
        own.chars, own.lengths = np.frombuffer(b"".join(terms), np.uint8), np.fromiter(map(len, terms), np.int64, len(terms))
        own.starts = np.cumsum(own.lengths) - own.lengths
        own.hashes = hash_runs(own.chars, own.starts, own.starts + own.lengths)
        self.known = KnownWords()
        self.known.add(own)
        self.unique = len(np.unique(own.hashes)) == len(terms)

    def __len__(self) -> int:
        return len(self.place)

    def find(self, runs: Runs) -> np.ndarray:
        """The number of each run's term, -1 where it is none."""
        if not self.unique:  # terms that share a hash
            raw = runs.chars.tobytes()
            return np.array([self.place.get(raw[s:e], -1) for s, e in zip(runs.starts.tolist(), runs.ends.tolist(), strict=True)], np.int64)
        asked = object.__new__(Words)
        asked.chars, asked.starts, asked.lengths, asked.hashes = runs.chars, runs.starts, runs.ends - runs.starts, runs.hashes()
        return self.known.find(asked)
