"""Toxicity: logistic regression over hashed word n-grams and skip-grams, learnt by FTRL-proximal.

A text is described by its words, pairs of neighbouring words, pairs with one or two words between them, and the first 4, 5 and 6
characters of longer words, all hashed into a fixed number of bins; a bin's value is log(1 + n) of its occurrences n. The learner
keeps two numbers for each bin: the sum of squared gradients, which sets the bin's own rate, and the sum of gradients less what the
weight has followed of it, in which the L1 bound holds all weights at zero that have not earned one. So a few hundred weights go
to the tasks, and scoring is a sum over a text's bins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .shingles import mix, seeded
from .terms import Runs
from .words import hash_runs, text_groups

BINS = 1 << 18
#: Neighbours that make pairs by their distance, and lengths of the word beginnings.
DISTANCES, STEMS = (1, 2, 3), (4, 5, 6)
#: Documents of either label that the learner sees, about, code points of them in all, and of the longest.
SAMPLE, SAMPLE_CHARS, LONGEST = (2500, 5000), 12_000_000, 60_000
#: Code points that a task describes at once.
CHARS_AT_ONCE = 250_000


def described(texts: list[str], bins: int = BINS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The filled bins of all texts: text, bin and value, by text and bin. Words are runs of letters, digits and signs beyond ASCII in lower case."""
    runs = Runs([t.lower() for t in texts])
    with np.errstate(over="ignore"):
        word = runs.hashes()
        of, grams = [runs.text], [mix(word ^ seeded(301))]
        for far in DISTANCES:
            same = runs.text[far:] == runs.text[:-far]
            of.append(runs.text[far:][same])
            grams.append(mix(mix(word[:-far] ^ seeded(310 + far)) + word[far:])[same])
        whole = (runs.chars & 0xC0) != 0x80  # bytes that begin a character
        at = np.flatnonzero(whole)
        nth = np.cumsum(whole) - 1
        last = nth[runs.ends - 1] if len(runs.ends) else nth[:0]
        for size in STEMS:
            longer = np.flatnonzero(last - nth[runs.starts] >= size)
            starts = runs.starts[longer]
            of.append(runs.text[longer])
            grams.append(mix(hash_runs(runs.chars, starts, at[nth[starts] + size]) ^ seeded(330 + size)))
    key, count = np.unique(np.concatenate(of) * bins + (np.concatenate(grams) % np.uint64(bins)).astype(np.int64), return_counts=True)
    return key // bins, key % bins, np.log1p(count)


@dataclass
class Toxicity:
    """Bins with a weight, in ascending order, their weights, and the intercept."""

    bins: np.ndarray
    weights: np.ndarray
    intercept: float
    n_bins: int = BINS

    def score(self, texts: list[str]) -> np.ndarray:
        """How likely each text is toxic."""
        text, feature, value = described(texts, self.n_bins)
        total = np.full(len(texts), self.intercept)
        if len(self.bins):
            at = np.minimum(np.searchsorted(self.bins, feature), len(self.bins) - 1)
            hit = self.bins[at] == feature
            total += np.bincount(text[hit], weights=self.weights[at[hit]] * value[hit], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


class Ftrl:
    """FTRL-proximal for logistic loss; the intercept has a rate of its own and no bounds."""

    def __init__(self, bins: int, rate: float = 0.7, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1):
        self.rate, self.beta, self.l1, self.l2 = rate, beta, l1, l2
        #: Of each bin, and last of the intercept.
        self.z, self.n = np.zeros(bins + 1), np.zeros(bins + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        free = at == len(self.z) - 1
        over = np.where(free, z, np.sign(z) * np.maximum(np.abs(z) - self.l1, 0))
        return -over / ((self.beta + np.sqrt(self.n[at])) / self.rate + np.where(free, 0, self.l2))

    def learn(self, feature: np.ndarray, value: np.ndarray, label: int) -> None:
        """One example; its bins are distinct."""
        at, x = np.append(feature, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        gradient = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        step = (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / self.rate
        self.z[at] += gradient - step * w
        self.n[at] = n + gradient * gradient


def fit_ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], share: float, bins: int = BINS, rounds: int = 8, seed: int = 5) -> Toxicity:
    """Go over the examples (bins, values, label) in rounds, each in an order of its own. ``share`` is that of label 1 among all documents:
    the intercept is moved as far as the examples' share is off. Without examples of both labels there are no weights: share alone."""
    labels = np.array([y for _, _, y in examples], np.int64)
    odds = lambda p: float(np.log(p / (1 - p)))
    if labels.sum() in (0, len(labels)):
        return Toxicity(np.zeros(0, np.int64), np.zeros(0), odds(share), bins)
    learner, rng = Ftrl(bins), np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(examples)).tolist():
            learner.learn(*examples[i])
    weights = learner.weights(np.arange(bins + 1))
    some = np.flatnonzero(weights[:-1])
    return Toxicity(some, weights[some], float(weights[-1]) + odds(share) - odds(labels.mean()), bins)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: tuple[int, int] = SAMPLE, sample_chars: int = SAMPLE_CHARS, longest: int = LONGEST,
) -> Toxicity:
    """Learn from labelled documents: ``labels`` has ids and labels 0 or 1; an id with both counts as 1, null ids and other labels don't count.

    Shares are those of all labels. The learner sees at most about ``sample`` documents of label 1 and of label 0, chosen by a hash of the
    id, of them texts of up to ``longest`` code points, and about ``sample_chars`` code points in all; of an id that several documents
    have, one text (the first in order). The driver gets the bins of these texts, some 5 bytes for each code point.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = known.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(1 << 40))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    chance = F.when(F.col("y") == 1, min(1.0, sample[0] / max(counts.get(1, 0), 1))).otherwise(min(1.0, sample[1] / max(counts.get(0, 0), 1)))
    chosen = known.where(F.col("h") < chance).withColumn("h", F.col("h") / chance)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text").between(1, longest))
    seen = staged(rows.join(F.broadcast(chosen), "id").groupBy("id", "y", "h").agg(F.min("text").alias("text")), "labelled")
    chars = seen.agg(F.sum(F.length("text"))).first()[0] or 0
    few = seen.where(F.col("h") < min(1.0, sample_chars / max(chars, 1)))

    def describe(batches):
        for part, texts in text_groups(batches, "text", CHARS_AT_ONCE):
            text, feature, value = described(texts)
            cut = np.searchsorted(text, np.arange(len(texts) + 1))
            rows = [(feature[a:b].astype("<i4").tobytes(), np.round(np.expm1(value[a:b])).astype("<i4").tobytes()) for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["y", "bins", "counts"])

    got = few.select("y", "text").mapInArrow(describe, "y int, bins binary, counts binary").toArrow()
    rows = sorted(zip(got.column("bins").to_pylist(), got.column("y").to_pylist(), got.column("counts").to_pylist(), strict=True))  # whatever the order they come in
    return fit_ftrl([(np.frombuffer(b, "<i4").astype(np.int64), np.log1p(np.frombuffer(c, "<i4")), y) for b, y, c in rows], share)


def toxicity(df: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """Score every row's text: ``id``, ``score`` (0 to 1, how likely it is toxic) and ``predicted`` (1 where the score is ``least`` or more).

    One row for each row of df, repeated ones too. A null or empty text, or one without words, scores what a text without any known sign
    does. Ids may be null or repeated; other columns are not read. No shuffle; a task describes a bounded stretch of texts at once, or one longer text.
    """

    def judge(batches):
        for part, texts in text_groups(batches, "text", CHARS_AT_ONCE):
            score = model.score(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= least).astype(np.int32))], ["id", "score", "predicted"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(judge, f"id {kind}, score double, predicted int")
