"""Texts of a task as flat code point arrays, cut into words, each distinct word kept once.

Tokenising works word by word, and most words repeat. So a task flattens some megabytes of texts, finds the places where words
start with array operations, numbers the distinct words and lets a tokenizer see each of them once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points that a task flattens at once, unless a single text is longer.
CHARS_AT_ONCE = 1_000_000
SLICE = 1 << 18
#: Stands for a special token among the code points; no text can hold it.
SPECIAL = 0x110000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of all elements of the runs that begin at starts."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def _scrambled(chars: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number of 64 bits for each character at its place in a word; not linear in either."""
    with np.errstate(over="ignore"):
        x = (place.astype(np.uint64) << np.uint64(21)) | chars.astype(np.uint64)
        x += np.uint64(1)
        x *= _ODD
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return x


def hash_runs(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of 64 bits for each word, none of which is empty: the sum of what its characters give at their places, scrambled again.

    Sums of powers modulo 2**64 would not do: they can't tell some long words of two letters from each other, whatever the base.
    """
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        first = 0
        while first < len(starts):
            lo = int(starts[first])
            last = max(first + 1, int(np.searchsorted(ends, lo + SLICE, "right")))
            hi = int(ends[last - 1])
            if last == first + 1:  # it may be longer than a slice
                for at in range(lo, hi, SLICE):
                    part = chars[at : min(hi, at + SLICE)]
                    out[first] += _scrambled(part, np.arange(at - lo, at - lo + len(part))).sum(dtype=np.uint64)
            else:
                s, e = starts[first:last] - lo, ends[first:last] - lo
                place = np.arange(hi - lo) - np.repeat(s, np.diff(np.append(s, hi - lo)))
                part = np.append(_scrambled(chars[lo:hi], place), np.uint64(0))
                out[first:last] = np.add.reduceat(part, np.stack([s, e], 1).ravel())[::2]
            first = last
        out += (ends - starts).astype(np.uint64) * _ODD
        out ^= out >> np.uint64(30)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(27)
    return out


def same_runs(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the runs of such lengths, none of them 0, hold the same characters in both arrays."""
    out = np.ones(len(lengths), bool)
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        base = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + SLICE, "right")))
        n = lengths[first:last]
        differs = a[ragged(a_starts[first:last], n)] != b[ragged(b_starts[first:last], n)]
        if differs.any():
            out[first:last] = ~np.logical_or.reduceat(differs, ends[first:last] - n - base)
        first = last
    return out


class Words:
    """The words of some texts: distinct ones as code points (chars, starts, lengths), and of every text their numbers in order."""

    def __init__(self, texts: list[str], find_starts: Callable[[np.ndarray, np.ndarray], np.ndarray], special: str | None = None, prefix=None):
        """find_starts(chars, first) flags the code points where words start; first flags those where a text or a part of one starts."""
        if prefix:
            texts = [prefix(t) for t in texts]
        joined = "".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        cuts = []
        if special and special in joined:
            chars, ends, cuts = self._mark(joined, chars, ends, texts, special)
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        flags = np.zeros(len(chars), bool)
        flags[begins[begins < len(chars)]] = True
        for at in cuts:
            flags[at] = True
            if at + 1 < len(chars):
                flags[at + 1] = True
        starts = np.flatnonzero(find_starts(chars, flags))
        word_ends = np.append(starts[1:], len(chars)) if len(starts) else starts
        self.text_ends = np.searchsorted(starts, ends, "left")
        self.text_begins = np.concatenate([[0], self.text_ends[:-1]]) if len(ends) else ends
        if len(starts) == 0:
            self.number = np.zeros(0, np.int64)
            self.chars, self.starts, self.lengths, self.hashes = chars[:0], starts, starts, np.zeros(0, np.uint64)
            return
        hashes, lengths = hash_runs(chars, starts, word_ends), word_ends - starts
        coded = pa.array(hashes).dictionary_encode()
        number = coded.indices.to_numpy()
        index = np.zeros(len(coded.dictionary), np.int64)
        index[number[::-1]] = np.arange(len(number) - 1, -1, -1)
        again = np.flatnonzero(index[number] != np.arange(len(number)))
        like = index[number[again]]
        if not (np.array_equal(lengths[again], lengths[like]) and same_runs(chars, starts[again], chars, starts[like], lengths[again]).all()):
            seen: dict[bytes, int] = {}  # words that share a hash: tell all apart by their characters
            raws = [chars[s:e].tobytes() for s, e in zip(starts.tolist(), word_ends.tolist(), strict=True)]
            number = np.fromiter((seen.setdefault(raw, len(seen)) for raw in raws), np.int64, len(raws))
            index = np.unique(number, return_index=True)[1]
        self.number = number
        self.hashes = hashes[index]
        self.lengths = lengths[index]
        self.chars = chars[ragged(starts[index], self.lengths)]
        self.starts = np.cumsum(self.lengths) - self.lengths

    @staticmethod
    def _mark(joined, chars, ends, texts, special):
        """Put one SPECIAL in place of each special string; such a string never crosses texts."""
        chars, keep, at, cuts = chars.copy(), np.ones(len(chars), bool), 0, []
        for t in texts:
            k = t.find(special)
            while k >= 0:
                chars[at + k] = SPECIAL
                keep[at + k + 1 : at + k + len(special)] = False
                cuts.append(at + k)
                k = t.find(special, k + len(special))
            at += len(t)
        before = np.concatenate([[0], np.cumsum(keep)])
        return chars[keep], before[ends], before[np.asarray(cuts)].tolist()

    def only(self, flags: np.ndarray) -> Words:
        """Some of the distinct words, without texts."""
        out = object.__new__(Words)
        out.lengths, out.hashes = self.lengths[flags], self.hashes[flags]
        out.chars = self.chars[ragged(self.starts[flags], out.lengths)]
        out.starts = np.cumsum(out.lengths) - out.lengths
        return out

    def utf8(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words' bytes, and the number of bytes of each word; special ones have none."""
        chars = self.chars
        size = np.where(chars < 0x80, 1, np.where(chars < 0x800, 2, np.where(chars < 0x10000, 3, np.where(chars < SPECIAL, 4, 0))))
        raw = chars[chars < SPECIAL].tobytes().decode("utf-32-le").encode("utf-8")
        lengths = np.add.reduceat(size, self.starts) if len(self.starts) else self.starts
        return np.frombuffer(raw, np.uint8), lengths

    def spread(self, values: np.ndarray, begins: np.ndarray, lengths: np.ndarray, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Lay out each text's words as the runs of values that stand for them; texts first to last. Also the number of values of each text."""
        last = len(self.text_ends) if last is None else last
        a, b = (int(self.text_begins[first]), int(self.text_ends[last - 1])) if last > first else (0, 0)
        number = self.number[a:b]
        n = lengths[number]
        sums = np.concatenate([[0], np.cumsum(n)])
        counts = sums[self.text_ends[first:last] - a] - sums[self.text_begins[first:last] - a]
        return values[ragged(begins[number], n)], counts


class KnownWords:
    """Words that a worker has met, each with a number; found by hash and told apart by their characters."""

    def __init__(self):
        self.sorted, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.chars, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def find(self, words: Words) -> np.ndarray:
        """The number of each distinct word, -1 for those not met. Of known words that share a hash only the first is found."""
        if not len(self):
            return np.full(len(words.starts), -1)
        at = np.searchsorted(self.sorted, words.hashes)
        at[at == len(self)] = 0
        row = self.order[at]
        found = np.flatnonzero((self.sorted[at] == words.hashes) & (self.lengths[row] == words.lengths))
        same = same_runs(self.chars, self.starts[row[found]], words.chars, words.starts[found], words.lengths[found])
        out = np.full(len(row), -1)
        out[found[same]] = row[found[same]]
        return out

    def add(self, words: Words) -> None:
        """Number further words on, in their order."""
        hashes = np.empty(len(self) + len(words.starts), np.uint64)
        hashes[self.order], hashes[len(self) :] = self.sorted, words.hashes
        self.starts = np.concatenate([self.starts, len(self.chars) + words.starts])
        self.chars = np.concatenate([self.chars, words.chars])
        self.lengths = np.concatenate([self.lengths, words.lengths])
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]


def text_groups(batches: Iterable[pa.RecordBatch], column: str, at_once: int = CHARS_AT_ONCE, rows: int | None = None) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose texts have about at_once bytes in all and are at most rows, and these texts; a null one is empty."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), float)))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + at_once, "right")))
            if rows:
                to = min(to, at + rows)
            part = batch.slice(at, to - at)
            yield part, [t or "" for t in part.column(part.schema.get_field_index(column)).to_pylist()]
            at = to


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Of each code point: 1 letter, 2 number, 3 white space, 0 other; SPECIAL is 4."""
    import regex

    table = np.zeros(SPECIAL + 1, np.uint8)
    every = np.concatenate([np.arange(0xD800), np.arange(0xE000, SPECIAL)]).astype(np.uint32)
    text = every.tobytes().decode("utf-32-le")
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, text):
            table[every[m.start() : m.end()]] = kind
    table[SPECIAL] = 4
    return table


def byte_level_starts(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the words of the byte-level tokenizers start: runs of letters, numbers or other signs, each with one space before it,
    short forms after an apostrophe, and white space, of which the last sign before a word stands alone or joins the word."""
    n = len(chars)
    if not n:
        return np.zeros(0, bool)
    kind = char_classes()[chars]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    start[kind == 4] = True
    last = np.flatnonzero((kind[:-1] == 3) & (kind[1:] != 3) & ~first[1:])
    start[last] = True
    start[last[chars[last] == 0x20] + 1] = False
    marks = np.flatnonzero((chars[:-1] == 0x27) & start[:-1] & (kind[1:] == 1) & ~first[1:])
    if len(marks):
        one = chars[marks + 1]
        far = np.minimum(marks + 2, n - 1)
        whole = (marks + 2 < n) & ~first[far]
        two = np.where(whole, chars[far], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        longer = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        hit = short | longer
        start[marks[hit] + 1] = False
        after = marks[hit] + np.where(short[hit], 2, 3)
        after = after[after < n]
        start[after[(kind[after] == 1)]] = True
    return start
