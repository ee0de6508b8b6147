"""Byte-level BPE: texts to token ids and back, by a pair occurrence index.

The distinct words of some megabytes of texts are encoded together. An index maps each mergeable pair to all the places where it
stands. The active rank that is lowest is taken, all its places are merged at once, and the lists of the pairs beside them are
brought up to date. A merge makes pairs of higher ranks only (checked when a vocabulary is read), so taking ranks in ascending
order over all words gives each word the same merges as taking them word by word.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import SPECIAL, KnownWords, Words, byte_level_starts, ragged, text_groups


#: Words whose ids a worker keeps at most.
KNOWN_WORDS = 400_000


def _byte_signs() -> dict[str, int]:
    """The sign that byte-level vocabularies write for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    signs = {chr(b): b for b in plain}
    signs |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return signs


class ByteBpe:
    """A vocabulary file of the tokenizers library with a byte-level BPE model; one special token at most."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, signs = spec["model"], _byte_signs()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if len(added) > 1 or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens of a kind that is not handled")
        self.special, self.special_id = next(iter(added.items()), (None, -1))
        vocab = model["vocab"]
        self.size = max([*vocab.values(), *added.values()]) + 1
        table = [b""] * self.size
        for piece, i in vocab.items():
            table[i] = piece.encode("utf-8") if piece in added else bytes(signs[c] for c in piece)
        for piece, i in added.items():
            table[i] = piece.encode("utf-8")
        self.piece_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.piece_lengths = np.fromiter(map(len, table), np.int64, self.size)
        self.piece_starts = np.cumsum(self.piece_lengths) - self.piece_lengths
        self.byte_ids = np.zeros(256, np.int64)
        for sign, b in signs.items():
            self.byte_ids[b] = vocab[sign]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        rank_of = np.full(self.size, -1, np.int64)
        rank_of[made] = np.arange(len(pairs))
        if np.any(rank_of[left] >= np.arange(len(pairs))) or np.any(rank_of[right] >= np.arange(len(pairs))):
            raise ValueError(f"{path} merges a token before it is made")
        keys = left * self.size + right
        order = np.argsort(keys)
        self.left, self.right, self.made = left, right, made
        at = np.minimum(np.searchsorted(keys[order], of_bytes := (self.byte_ids[:, None] * self.size + self.byte_ids).ravel()), len(keys) - 1)
        self.byte_ranks = np.where(keys[order][at] == of_bytes, order[at], -1).astype(np.int32)
        #: For each token, the pairs it begins and those it ends: ranks in runs, found by where the token's run starts.
        self.begun, self.ended = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
        self.begun_at, self.ended_at = (np.searchsorted(side[by], np.arange(self.size + 1)) for side, by in ((left, self.begun), (right, self.ended)))
        self.dense = np.full(self.size, -1, np.int32)

        self.forget()

    def forget(self) -> None:
        """Know no words: their ids, and where each word's begin and how many they are."""
        self.known, self.ids, self.begins, self.counts = KnownWords(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ranks_with(self, token: int, others: np.ndarray, begins: bool) -> np.ndarray:
        """Rank of the pair of token and each other one, -1 where it never merges; begins: token is the left one."""
        by, at, other = (self.begun, self.begun_at, self.right) if begins else (self.ended, self.ended_at, self.left)
        ranks = by[at[token] : at[token + 1]]
        if not len(ranks):
            return np.full(len(others), -1, np.int32)
        self.dense[other[ranks]] = ranks
        out = self.dense[others]
        self.dense[other[ranks]] = -1
        return out

    def encode_words(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as bytes one after another; also the number of ids of each word."""
        n = len(raw)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
        symbol = self.byte_ids[raw].astype(np.int32)
        after, before = np.arange(1, n + 1, dtype=np.int64), np.arange(-1, n - 1, dtype=np.int64)
        ends = np.cumsum(lengths)
        filled = ends[lengths > 0]
        after[filled - 1] = -1
        before[np.concatenate([[0], filled[:-1]])] = -1
        #: Rank of the pair that starts at each place, -1 where none does.
        rank = np.full(n, -1, np.int32)
        rank[:-1] = self.byte_ranks[raw[:-1].astype(np.int64) * 256 + raw[1:]]
        rank[after < 0] = -1
        places: dict[int, list[np.ndarray]] = {}
        gone, merged = np.zeros(n, bool), np.zeros(n, bool)

        def note(at: np.ndarray) -> None:
            of = rank[at]
            if not len(at):
                return
            order = np.argsort(of.astype(small), kind="stable")
            at, of = at[order], of[order]
            cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
            edges = [0, *cuts.tolist(), len(at)]
            for r, a, b in zip(of[[0, *cuts]].tolist(), edges, edges[1:], strict=False):
                if r in places:
                    places[r].append(at[a:b])
                else:
                    places[r] = [at[a:b]]
                    heapq.heappush(active, r)

        active: list[int] = []
        small = np.uint16 if len(self.made) < 1 << 16 else np.int32  # of 16 bits, sorted by radix
        note(np.flatnonzero(rank >= 0))
        while active:
            r = heapq.heappop(active)
            lists = places.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[rank[at] == r]
            if not len(at):
                continue
            if self.left[r] == self.right[r] and len(at) > 1:  # of places that overlap, every other one from the left
                at = np.sort(at)
                fresh = np.concatenate([[True], after[at[:-1]] != at[1:]])
                run = np.flatnonzero(fresh)
                at = at[(np.arange(len(at)) - run[np.cumsum(fresh) - 1]) % 2 == 0]
            taken = after[at]
            beyond = after[taken]
            symbol[at] = self.made[r]
            after[at] = beyond
            linked = beyond >= 0
            before[beyond[linked]] = at[linked]
            rank[taken] = -1
            gone[taken] = True
            rank[at] = -1
            made = int(self.made[r])
            right, left = at[linked], before[at]
            left = left[left >= 0]
            merged[at] = True
            left = left[~merged[left]]
            merged[at] = False
            of_right, of_left = self.ranks_with(made, symbol[beyond[linked]], True), self.ranks_with(made, symbol[left], False)
            rank[right], rank[left] = of_right, of_left
            note(np.concatenate([right[of_right >= 0], left[of_left >= 0]]))
        stays = ~gone
        counts = np.zeros(len(lengths), np.int64)
        counts[lengths > 0] = np.add.reduceat(stays.astype(np.int64), (ends - lengths)[lengths > 0])
        return symbol[stays], counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each text."""
        words = Words(texts, byte_level_starts, self.special)
        if not len(words.starts):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        row = self.known.find(words)
        if len(self.known) + int((row < 0).sum()) > KNOWN_WORDS:  # start anew with this group's words
            self.forget()
            row[:] = -1
        new = row < 0
        if new.any():
            fresh = words.only(new)
            raw, lengths = fresh.utf8()
            more, n = self.encode_words(raw, lengths)
            marks = fresh.chars[fresh.starts] == SPECIAL
            if marks.any():  # a special word has no bytes; its one id goes where its ids would stand
                more, n = np.insert(more, (np.cumsum(n) - n)[marks], self.special_id), n + marks
            row[new] = len(self.known) + np.arange(len(n))
            self.known.add(fresh)
            self.begins, self.counts = np.concatenate([self.begins, len(self.ids) + np.cumsum(n) - n]), np.concatenate([self.counts, n])
            self.ids = np.concatenate([self.ids, more])
        return words.spread(self.ids, self.begins[row], self.counts[row])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for, one after another."""
        return self.piece_bytes[ragged(self.piece_starts[ids], self.piece_lengths[ids])]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBpe:
    """Read once in each Python worker."""
    return ByteBpe(path)


def encoded_groups(batches, column: str, path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """For slices of the batches: the slice, all ids of its texts and the number of ids of each."""
    bpe = vocabulary(path)
    for part, texts in text_groups(batches, column):
        ids, counts = bpe.encode(texts)
        yield part, ids, counts


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each text: ``id``, ``ids`` (little-endian unsigned 32-bit integers) and ``n_tokens``.

    One row for each row of df, repeated ones too. A null or empty text has no ids; the id column may hold nulls and repeats; other
    columns are not read. The special token's string counts as that token. Texts and words may be of any length. No shuffle; a task holds
    some megabytes of texts, or one longer text.
    """

    def encode(batches):
        for part, ids, counts in encoded_groups(batches, "text", path):
            ends = np.cumsum(counts)
            raw = ids.astype("<u4").tobytes()
            rows = [raw[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary()), pa.array(counts, pa.int64())], ["id", "ids", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(encode, f"id {kind}, ids binary, n_tokens long")


def bpe_decode(df: DataFrame, path: str, keep: tuple[str, ...] = ("id",), ids_col: str = "ids") -> DataFrame:
    """The text of each row's ids, as ``text`` beside the columns to keep; bytes that are no UTF-8 become U+FFFD. Null ids: empty text."""
    frame = df.select(*[df[c] for c in keep], df[ids_col].alias("_ids"))

    def decode(batches):
        bpe = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raws = [r or b"" for r in part.column(part.num_columns - 1).to_pylist()]
                ids = np.frombuffer(b"".join(raws), "<u4").astype(np.int64)
                counts = np.fromiter((len(r) // 4 for r in raws), np.int64, len(raws))
                sizes = np.concatenate([[0], np.cumsum(bpe.piece_lengths[ids])])
                ends = sizes[np.cumsum(counts)].tolist()
                whole = bpe.decode(ids).tobytes()
                texts, last = [], 0
                for e in ends:
                    texts.append(whole[last:e].decode("utf-8", "replace"))
                    last = e
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    schema = ", ".join([f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in keep] + ["text string"])
    return frame.mapInArrow(decode, schema)
