"""Quality classifier from weak labels.

Heuristic labellers vote good or bad on every document, or abstain. How often each combination of votes occurs is counted over all
documents; expectation-maximisation over these combinations (a bounded table) estimates what each labeller's votes are worth and,
for each combination, how likely a document is bad. A linear scorer over hashed shapes of the text learns these posteriors on a
bounded sample and then scores every document, also where all labellers abstain; it sees the shapes, words and pairs of words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import _BLANKS, mix, seeded
from .tasks import lean
from .words import CHARS_AT_ONCE, hash_runs, text_groups

#: Hashed features: runs of four signs by kind, and a few bins for words and lines that repeat.
BINS, REPEATS = 1000, 24
FEATURES = BINS + REPEATS
#: Hashed words and pairs of neighbouring words, beside them.
WORDS = 2048
#: Texts whose features a task holds at once, some kilobytes each however short the text is.
TEXTS_AT_ONCE = 1024
#: Documents that the scorer learns from, about; chosen by a hash of the text.
SAMPLE = 3000
LABELLERS = ("symbols", "capitals", "repeats", "shouts", "bars", "variety", "endings", "lone_signs", "signs", "menus", "bare_lines", "links", "long_words", "digits", "plain", "lower", "fresh")
ABSTAIN, GOOD, BAD = 0, 1, 2
#: Kinds of junk, and the kinds that each labeller claims to know; the last three know prose.
KINDS = ("symbols", "shouting", "repetition", "tables", "menus", "links", "noise")
KNOWN = ((0,), (1,), (2,), (1,), (3,), (2,), (0, 1), (3,), (0, 1, 3, 5), (4,), (4,), (5,), (6,), (6,), (), (), ())

_KIND = np.arange(256, dtype=np.uint8)
_KIND[ord("a") : ord("z") + 1] = _KIND[0x80:] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3


#: Features of texts: shapes as rows, and the filled bins of words and pairs (text, bin, value).
Features = tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]


def describe(texts: list[str]) -> tuple[dict[str, np.ndarray], Features]:
    """Measures of each text by name, and its hashed features: square roots of shares."""
    n = len(texts)
    raws = [t.encode("utf-8") for t in texts]
    chars = np.frombuffer(b"".join(raws), np.uint8)
    sizes = np.fromiter(map(len, raws), np.int64, n)
    ends = np.cumsum(sizes)
    text_of = np.repeat(np.arange(n), sizes)
    first = np.zeros(len(chars), bool)
    first[(ends - sizes)[sizes > 0]] = True

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return (sums[ends] - sums[ends - sizes]).astype(float)

    def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, stop = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1] | first[1:]
        stop[:-1] &= ~inside[1:] | first[1:]
        starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
        return starts, text_of[starts], hash_runs(chars, starts, stops)

    def repeats(of: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of runs, of runs like the one before, and of distinct ones, in each text."""
        total = np.bincount(of, minlength=n).astype(float)
        same = np.zeros(len(of), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        _, index = np.unique(mix(hashes ^ mix(of.astype(np.uint64) + seeded(7))), return_index=True)
        return total, np.bincount(of[same], minlength=n).astype(float), np.bincount(of[index], minlength=n).astype(float)

    blank = _BLANKS[chars]
    word_starts, word_of, word = runs(~blank)
    word_ends = np.append(word_starts[1:], len(chars)) if len(word_starts) else word_starts
    ends_word = ~blank
    ends_word[:-1] &= blank[1:] | first[1:]
    word_sizes = np.flatnonzero(ends_word) + 1 - word_starts
    kind = _KIND[chars]
    told = (kind >= 1) & (kind <= 3)
    told_before = np.concatenate([[0], np.cumsum(told)])
    lone = told_before[word_ends] == told_before[word_starts]
    odd_ends = per_text(ends_word & ~told & ~np.isin(chars, np.frombuffer(b".,;:?)\"'", np.uint8)))
    words, same_words, distinct = repeats(word_of, word)
    line_starts, line_of, line = runs(chars != 10)
    lines, same_lines, distinct_lines = repeats(line_of, line)
    ends_line = chars != 10
    ends_line[:-1] &= (chars[1:] == 10) | first[1:]
    line_ends = chars[ends_line]
    bare = (line_ends < 0x80) & ~np.isin(line_ends, np.frombuffer(b".!?:;,)\"'", np.uint8))
    in_line = np.bincount(np.searchsorted(line_starts, word_starts, "right") - 1, minlength=len(line_starts)) if len(line_starts) else np.zeros(0, np.int64)
    schemes = np.zeros(len(chars), bool)
    schemes[: max(len(chars) - 2, 0)] = (chars[:-2] == ord(":")) & (chars[1:-1] == ord("/")) & (chars[2:] == ord("/"))
    upper, letters = per_text(kind == 2), per_text((kind == 1) | (kind == 2))
    measures = {
        "words": words, "symbols": per_text(np.isin(chars, np.frombuffer(b"#*$%&<>", np.uint8))), "signs": per_text(~blank), "upper": upper, "letters": letters,
        "same_words": same_words, "distinct": distinct, "shouts": per_text(chars == ord("!")), "bars": per_text(chars == ord("|")), "lines": lines, "distinct_lines": distinct_lines,
        "lone": np.bincount(word_of[lone], minlength=n).astype(float), "odd_ends": odd_ends, "untold": per_text(~blank & ~told),
        "short_lines": np.bincount(line_of[(in_line > 0) & (in_line <= 3)], minlength=n).astype(float), "bare_lines": np.bincount(line_of[bare], minlength=n).astype(float), "links": per_text(schemes), "digits": per_text(kind == 3),
        "long_words": np.bincount(word_of[word_sizes > 25], minlength=n).astype(float),
    }
    grams = np.zeros((n, FEATURES))
    if len(chars) > 3:
        code = kind.astype(np.uint64)
        whole = text_of[3:] == text_of[:-3]
        gram = ((code[:-3] << np.uint64(24)) | (code[1:-2] << np.uint64(16)) | (code[2:-1] << np.uint64(8)) | code[3:])[whole]
        grams[:, :BINS] = np.bincount(text_of[3:][whole] * BINS + (mix(gram + seeded(3)) % np.uint64(BINS)).astype(np.int64), minlength=n * BINS).reshape(n, BINS)
    grams[:, :BINS] /= grams[:, :BINS].sum(axis=1, keepdims=True) + 100  # a short text shows little
    shares = [same_words / np.maximum(words, 1), 1 - distinct / np.maximum(words, 1), 1 - distinct_lines / np.maximum(lines, 1)]
    for k, share in enumerate(shares):
        step = np.minimum((share * 8).astype(int), 7)
        grams[np.arange(n), BINS + 8 * k + step] = words / (words + 20) / 3
    together = word_of[1:] == word_of[:-1]
    with np.errstate(over="ignore"):
        pairs = mix(mix(word[:-1] ^ seeded(5)) + word[1:])[together]
    hashed = np.concatenate([mix(word ^ seeded(4)), pairs]) % np.uint64(WORDS)
    key, count = np.unique(np.concatenate([word_of, word_of[1:][together]]) * WORDS + hashed.astype(np.int64), return_counts=True)
    return measures, (np.sqrt(grams), (key // WORDS, key % WORDS, np.sqrt(count / (2 * words[key // WORDS] + 100))))


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """A row of votes for each text, in the order of LABELLERS: fourteen that know kinds of junk, each kind known to two or more, and vote bad or abstain, three
    that know a trait of prose and vote good or abstain. A text without words gets none."""
    words, signs, letters = np.maximum(m["words"], 1), np.maximum(m["signs"], 1), np.maximum(m["letters"], 1)
    some = m["words"] > 0
    bad = [
        m["symbols"] / signs >= 0.05,
        (m["upper"] / letters >= 0.4) & (m["letters"] >= 20),
        (m["same_words"] / words >= 0.2) & (m["words"] >= 10),
        (m["shouts"] / words >= 0.2) & (m["words"] >= 5),
        (m["bars"] / words >= 0.1) & (m["words"] >= 10),
        (m["distinct"] / words <= 0.15) & (m["words"] >= 20),
        (m["odd_ends"] / words >= 0.2) & (m["words"] >= 5),
        (m["lone"] / words >= 0.1) & (m["words"] >= 10),
        (m["untold"] / signs >= 0.12) & (m["words"] >= 10),
        (m["lines"] >= 8) & (m["short_lines"] / np.maximum(m["lines"], 1) >= 0.7),
        (m["lines"] >= 8) & (m["bare_lines"] / np.maximum(m["lines"], 1) >= 0.8),
        (m["links"] / words >= 0.1) & (m["words"] >= 5),
        (m["long_words"] / words >= 0.3) & (m["words"] >= 5),
        (m["digits"] / signs >= 0.4) & (m["words"] >= 5),
    ]
    good = [
        m["untold"] / signs <= 0.08,
        m["upper"] / letters <= 0.15,
        (m["same_words"] / words <= 0.05) & (m["distinct"] / words >= 0.25),
    ]
    return np.stack([np.where(x & some, BAD, ABSTAIN) for x in bad] + [np.where(x & some, GOOD, ABSTAIN) for x in good], axis=1)


@dataclass
class LabelModel:
    """Shares of prose and of each kind of junk, and for each of these classes, labeller and vote its probability."""

    shares: np.ndarray
    table: np.ndarray

    def classes(self, votes: np.ndarray) -> np.ndarray:
        """How likely a document with these votes is of each class; prose comes first."""
        index = np.arange(votes.shape[1])
        logs = np.stack([np.log(p) + np.log(t[index, votes]).sum(axis=1) for p, t in zip(self.shares, self.table, strict=True)], axis=1)
        odds = np.exp(logs - logs.max(axis=1, keepdims=True)) if len(logs) else logs
        return odds / odds.sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """How likely a document with these votes is bad."""
        return 1 - self.classes(votes)[:, 0]


def fit_labels(patterns: np.ndarray, counts: np.ndarray, steps: int = 100) -> LabelModel:
    """Expectation-maximisation over combinations of votes and how often each occurs.

    Junk is of several kinds, as labellers that know one kind are silent on the others: with a single bad class, a document of
    which all but one labeller are silent would count as prose. Pseudo-counts of 1 % of the documents hold what the labellers claim:
    four in five documents of a kind that a labeller knows get its bad vote, three in a hundred of the others do, and nine in ten of prose
    get a good vote. The estimates start from these claims. No documents: the claims alone.
    """
    n = max(float(counts.sum()), 1.0)
    claims = np.empty((1 + len(KINDS), len(LABELLERS), 3))
    for c in range(len(claims)):
        for j, kinds in enumerate(KNOWN):
            claims[c, j] = ([0.196, 0.004, 0.8] if c - 1 in kinds else [0.966, 0.004, 0.03]) if kinds else ([0.096, 0.9, 0.004] if c == 0 else [0.498, 0.498, 0.004])
    model = LabelModel(np.array([0.9, *[0.1 / len(KINDS)] * len(KINDS)]), claims)
    for _ in range(steps if len(patterns) else 0):
        weight = model.classes(patterns) * counts[:, None]
        table = np.stack([[np.bincount(patterns[:, j], weights=w, minlength=3) for j in range(len(LABELLERS))] for w in weight.T]) + 0.01 * n * claims
        shares = weight.sum(axis=0) + 0.001 * n
        new = LabelModel(shares / shares.sum(), table / table.sum(axis=2, keepdims=True))
        done = np.abs(new.shares - model.shares).max() < 1e-9
        model = new
        if done:
            break
    return model


def fit_scorer(rows: np.ndarray, target: np.ndarray, steps: int = 200, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by accelerated gradient steps; weights and intercept. No rows: all zero."""
    if not len(rows):
        return np.zeros(FEATURES + WORDS), 0.0
    x = np.hstack([rows, np.ones((len(rows), 1))]).astype(np.float32)
    target = target.astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    rate = 4.0 / float((x * x).sum(axis=1).max())
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -50, 50)))
        new = v - np.float32(rate) * (x.T @ (p - target) / np.float32(len(rows)) + np.float32(decay) * np.append(v[:-1], np.float32(0)))
        v = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w[:-1].astype(float), float(w[-1])


def _code(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(v.shape[1])).sum(axis=1)


def _votes_of(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3**j % 3 for j in range(len(LABELLERS))], axis=1)


@dataclass
class Classifier:
    labels: LabelModel
    weights: np.ndarray
    intercept: float

    def score(self, features: Features) -> np.ndarray:
        """How likely each text with these features is good."""
        shapes, (text, feature, value) = features
        total = shapes @ self.weights[:FEATURES] + np.bincount(text, weights=self.weights[FEATURES:][feature] * value, minlength=len(shapes))
        return 1 / (1 + np.exp(np.clip(total + self.intercept, -700, 700)))


def fit_classifier(df: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Classifier:
    """Label model from the votes on all rows, scorer from about ``sample`` of them, chosen by a hash of the text.

    The driver gets the counts of at most 2 ** 17 combinations of votes and the sample's features. Null and empty texts have no part.
    """

    def cast(batches):
        for _, texts in text_groups(batches, "text", CHARS_AT_ONCE // 8, TEXTS_AT_ONCE):
            yield pa.RecordBatch.from_arrays([pa.array(_code(votes(describe(texts)[0])))], ["code"])

    def show(batches):
        for _, texts in text_groups(batches, "text", CHARS_AT_ONCE // 8, TEXTS_AT_ONCE):
            measures, (shapes, (text, feature, value)) = describe(texts)
            rows = np.zeros((len(texts), FEATURES + WORDS), "<f4")
            rows[:, :FEATURES] = shapes
            rows[text, FEATURES + feature] = value
            packed = [r.tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(_code(votes(measures))), pa.array(packed, pa.binary())], ["code", "features"])

    texts = df.select(df[text_col].alias("text")).where("length(text) > 0")
    seen = texts.mapInArrow(lean(cast), "code long").groupBy("code").count().collect()
    codes, counts = np.array([r["code"] for r in seen], np.int64), np.array([r["count"] for r in seen], float)
    labels = fit_labels(_votes_of(codes), counts)
    every = 1 << 40
    chance = min(1.0, sample / max(float(counts.sum()), 1.0))
    chosen = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) < int(chance * every)).distinct()
    got = chosen.mapInArrow(lean(show), "code long, features binary").orderBy("features").collect()
    rows = np.frombuffer(b"".join(bytes(r["features"]) for r in got), "<f4").reshape(-1, FEATURES + WORDS)
    target = labels.posterior(_votes_of(np.array([r["code"] for r in got], np.int64)))
    return Classifier(labels, *fit_scorer(rows, target))


def classify(df: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Votes and scores of every row: ``id``, the columns to keep, ``n_bad, n_good`` (votes), ``posterior`` (of being good, by the
    votes), ``score`` (of being good, by the scorer) and ``kept``: a score of at least ``least``.

    One row for each row of df, repeated ones too. A text without words, a null or an empty one has no votes, scores 0 and is not
    kept. Ids may be null or repeated; other columns are not read. Texts may be of any length. No shuffle.
    """
    names = [f"_keep{k}" for k in range(len(keep))]
    rows = df.select(df[id_col].alias("id"), *[df[c].alias(n) for c, n in zip(keep, names, strict=True)], df[text_col].alias("text"))

    def judge(batches):
        for part, texts in text_groups(batches, "text", CHARS_AT_ONCE // 8, TEXTS_AT_ONCE):
            measures, features = describe(texts)
            v = votes(measures)
            some = measures["words"] > 0
            score = np.where(some, model.score(features), 0.0)
            posterior = np.where(some, 1 - model.labels.posterior(v), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array((v == BAD).sum(axis=1)), pa.array((v == GOOD).sum(axis=1)), pa.array(posterior), pa.array(score), pa.array(score >= least)],
                [*part.schema.names[:-1], "n_bad", "n_good", "posterior", "score", "kept"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(lean(judge), schema + ", n_bad long, n_good long, posterior double, score double, kept boolean")
    return out.select("id", *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "n_bad", "n_good", "posterior", "score", "kept")
