"""Token counts under a unigram vocabulary, without making the tokens.

Words are cut as sentence pieces are: the space before a word belongs to it, and every text starts with one. All places where a
piece of the vocabulary stands in the distinct words come from one Aho-Corasick automaton. Dynamic programming then goes over the
words' characters, for all words at once, and carries two numbers for each character: the best score of a segmentation that ends
there and its number of tokens.

Ties go as in the tokenizers library's Unigram model: candidates for an end are met by ascending start, and only a higher score
replaces an earlier one; so of equal scores, the longest last piece stays. A character that no piece of one character covers is
unknown; it scores 10 less than the lowest score and becomes one token for each of its bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import KnownWords, Words, text_groups

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker keeps at most.
KNOWN_WORDS = 1_000_000


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with unigram scores. A file with merge ranks for scores gets log probabilities by Zipf's law
    of the rank; control and byte pieces score as the last rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces, scores = [model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)]
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    if len({scores[i] for i in plain}) > 1 and all(float(scores[i]).is_integer() for i in plain):
        total = sum(1.0 / k for k in range(1, len(plain) + 1))
        rank = {i: k + 1 for k, i in enumerate(sorted(plain, key=lambda i: (-scores[i], i)))}
        return [(pieces[i], -float(np.log(rank.get(i, len(plain)) * total))) for i in range(n)]
    return list(zip(pieces, scores, strict=True))


def word_starts(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words start at each space or mark."""
    return first | (chars == 0x20) | (chars == ord(MARK))


def marked(text: str) -> str:
    """The text with the space before its first word; an empty one stays empty."""
    return text if not text or text[0] in (" ", MARK) else " " + text


class Unigram:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, (piece, _) in enumerate(pieces):
            if piece:
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.scores = np.array([s for _, s in pieces], float)
        self.sizes = np.array([len(p) for p, _ in pieces], np.int64)
        self.forget()
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY

    def forget(self) -> None:
        self.known, self.counts = KnownWords(), np.zeros(0, np.int64)

    def count_words(self, words: Words) -> np.ndarray:
        """Number of tokens of each distinct word."""
        n_words = len(words.starts)
        if not n_words:
            return np.zeros(0, np.int64)
        chars = np.where(words.chars == 0x20, ord(MARK), words.chars).astype(np.uint32)
        text = chars.tobytes().decode("utf-32-le")
        found = np.fromiter(self.automaton.iter(text), [("end", np.int64), ("piece", np.int64)])
        word = np.repeat(np.arange(n_words), words.lengths)
        base = words.starts[word]
        end, piece = found["end"], found["piece"]
        start = end - self.sizes[piece] + 1
        inside = start >= base[end]  # else it crosses words
        end, start, score = end[inside], start[inside], self.scores[piece[inside]]
        single = np.zeros(len(chars), bool)
        single[end[start == end]] = True
        alone = np.flatnonzero(~single)
        code = chars[alone]
        size = np.where(code < 0x80, 1, np.where(code < 0x800, 2, np.where(code < 0x10000, 3, 4)))
        #: By end and, as the automaton tells the longest piece first, by start; unknown characters are the shortest.
        order = np.argsort(np.concatenate([end, alone]), kind="stable")
        tokens = np.concatenate([np.ones(len(end), np.int64), size])
        end, start = np.concatenate([end, alone]), np.concatenate([start, alone])
        score = np.concatenate([score, np.full(len(alone), self.unknown)])
        at = (end - base[end] + 1)[order]  # characters of the word up to the piece's end
        by_step = np.argsort(at.astype(np.uint16) if words.lengths.max() < 1 << 16 else at, kind="stable")
        order, at = order[by_step], at[by_step]
        end, start, score, tokens = end[order], start[order], score[order], tokens[order]
        #: Best score and count up to before each character, and one more for the end of each word.
        slot = np.arange(len(chars)) + word
        best, count = np.full(len(chars) + n_words, -np.inf), np.zeros(len(chars) + n_words, np.int64)
        best[words.starts + np.arange(n_words)] = 0.0
        from_slot, to_slot = slot[start], slot[end] + 1
        steps = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])).tolist() + [len(at)]
        for a, b in zip(steps, steps[1:], strict=False):
            f, to = from_slot[a:b], to_slot[a:b]
            total = best[f] + score[a:b]
            heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            top = np.maximum.reduceat(total, heads)
            lengths = np.diff(np.append(heads, b - a))
            wins = np.flatnonzero(total == np.repeat(top, lengths))
            group = np.repeat(np.arange(len(heads)), lengths)[wins]
            first = wins[np.concatenate([[True], group[1:] != group[:-1]])]  # starts ascend, so the longest piece
            best[to[heads]], count[to[heads]] = top, count[f[first]] + tokens[a:b][first]
        return count[words.starts + words.lengths + np.arange(n_words)]

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        words = Words(texts, word_starts, prefix=marked)
        row = self.known.find(words)
        if len(self.known) + int((row < 0).sum()) > KNOWN_WORDS:
            self.forget()
            row[:] = -1
        new = row < 0
        if new.any():
            fresh = words.only(new)
            row[new] = len(self.known) + np.arange(len(fresh.starts))
            self.known.add(fresh)
            self.counts = np.concatenate([self.counts, self.count_words(fresh)])
        of_word = self.counts[row]
        sums = np.concatenate([[0], np.cumsum(of_word[words.number])])
        return sums[words.text_ends] - sums[words.text_begins]


@lru_cache(maxsize=2)
def unigram(path: str) -> Unigram:
    """Built once in each Python worker."""
    return Unigram(read_pieces(path))


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of tokens of every row's text: ``id, n_tokens``.

    One row for each row of df, repeated ones too. A null or empty text has 0 tokens. Ids may be null or repeated; other columns are
    not read. Texts and words may be of any length. No shuffle; a task holds some megabytes of texts at once, or one longer text.
    """

    def count(batches):
        model = unigram(path)
        for part, texts in text_groups(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.count(texts), pa.int64())], ["id", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(count, f"id {kind}, n_tokens long")
