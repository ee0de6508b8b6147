"""Toxicity: features and learner against plain Python, and held-out accuracy."""

import math
import re
import zlib

import numpy as np
import pytest

from rollbook.llm import toxicity as tox
from rollbook.llm.queries import QUERIES
from rollbook.llm.toxicity import Ftrl, Toxicity, described, fit_ftrl, fit_toxicity, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    """Grams of a text as strings, with repeats."""
    words = WORD.findall(text.lower())
    grams = list(words)
    for far in (1, 2, 3):
        grams += [f"{a} {far} {b}" for a, b in zip(words, words[far:], strict=False)]
    for size in (4, 5, 6):
        grams += [f"^{size}{w[:size]}" for w in words if len(w) > size]
    return grams


def test_bins_are_those_of_the_grams(texts):
    """As many bins as distinct grams, with their counts, where there is room enough for no two to meet."""
    some = [t or "" for t in texts[:100]]
    text, feature, value = described(some, 1 << 40)
    for k, t in enumerate(some):
        want = sorted(plain_features(t).count(g) for g in set(plain_features(t)))
        assert sorted(np.round(np.expm1(value[text == k])).astype(int).tolist()) == want
        assert len(set(feature[text == k].tolist())) == len(want)


def test_the_same_words_fall_into_the_same_bins():
    text, feature, _ = described(["Ünder the tree", "", "so ünder THE tree, ünders", "tree the ünder"])
    bins = [set(feature[text == k].tolist()) for k in range(4)]
    assert bins[0] < bins[2] and not bins[1] and len(bins[0] & bins[3]) == 4  # three words and one beginning


def test_learner_is_ftrl():
    """Coordinate by coordinate, as the formula has it."""
    rng = np.random.default_rng(1)
    learner, z, n = Ftrl(12, rate=0.3, l1=0.5, l2=1.0), [0.0] * 13, [0.0] * 13

    def weight(i):
        l1, l2 = (0, 0) if i == 12 else (0.5, 1.0)
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((1 + math.sqrt(n[i])) / 0.3 + l2)

    for _ in range(200):
        at = rng.choice(12, 4, replace=False)
        x, y = rng.random(4), int(rng.random() < 0.5)
        learner.learn(at, x, y)
        pairs = [*zip(at.tolist(), x.tolist(), strict=True), (12, 1.0)]
        w = {i: weight(i) for i, _ in pairs}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in pairs)))
        for i, v in pairs:
            g = (p - y) * v
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.3
            z[i] += g - sigma * w[i]
            n[i] += g * g
    assert np.allclose(learner.weights(np.arange(13)), [weight(i) for i in range(13)])


def test_weights_are_sparse_and_found():
    rng = np.random.default_rng(3)
    examples = []
    for _ in range(800):
        y = int(rng.random() < 0.3)
        noise = np.unique(rng.integers(10, 5000, 30))
        examples.append((np.concatenate([[y * 2 + int(rng.integers(0, 2))], noise]), np.ones(len(noise) + 1), y))
    model = fit_ftrl(examples, 0.3, bins=5000)
    assert len(model.bins) < 300 and model.weights[model.bins == 2][0] > 1 and model.weights[model.bins == 3][0] > 1


def test_one_kind_of_label_gives_the_share():
    assert fit_ftrl([], 0.5).intercept == 0 and fit_ftrl([(np.array([1]), np.array([1.0]), 1)], 0.9).score(["a", ""]).tolist() == pytest.approx([0.9, 0.9])


def test_scores_and_rows(spark, frame, empty, texts):
    model = Toxicity(*(x for x in described(["stupid"])[1:3]), -2.0)
    rows = toxicity(frame, model).collect()
    assert len(rows) == len(texts) and all(r["score"] == pytest.approx(1 / (1 + math.e**2)) and r["predicted"] == 0 for r in rows)
    assert toxicity(empty, model).collect() == []
    long = spark.createDataFrame([(1, "a " * 700_000 + "stupid"), (2, "stupid " * 60), (3, "x" * 600_000)], "doc_id long, text string")
    assert [r["score"] > 0.1195 for r in toxicity(long, model).orderBy("id").collect()] == [True, True, False]


def test_labels_of_all_kinds(spark):
    """Repeated, contradictory, null and odd labels; repeated ids and empty texts among the documents."""
    good, bad = "the tree stands by the river", "you are a stupid clown"
    docs = [(k, (bad if k % 4 == 0 else good) + f" {k}") for k in range(400)]
    docs += [(0, "zzz"), (0, bad + " 0"), (None, bad), (500, ""), (501, None)]
    labels = [(k, int(k % 4 == 0)) for k in range(400)] + [(4, 0), (8, 1), (None, 1), (9, None), (13, 7), (500, 1), (501, 0), (777, 1)]
    model = fit_toxicity(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, toxic int"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.score([bad, good, ""]).round().tolist() == [1, 0, 0]
    none = fit_toxicity(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.score(["a", ""]).tolist() == [0.5, 0.5]


def test_the_sample_is_bounded(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat(if(id % 3 = 0, 'foul ', 'fine '), id) AS text")
    labels = spark.range(3000).selectExpr("id AS doc_id", "int(id % 3 = 0) AS toxic")
    seen = []
    real = tox.fit_ftrl
    try:
        tox.fit_ftrl = lambda examples, share: seen.append((len(examples), share)) or real(examples, share)
        model = fit_toxicity(docs, labels, sample=(100, 200))
        fit_toxicity(docs, labels, sample=(100, 200), sample_chars=900)
    finally:
        tox.fit_ftrl = real
    assert 200 < seen[0][0] < 400 and 50 < seen[1][0] < 150 and seen[0][1] == pytest.approx(1 / 3, abs=0.01)
    assert model.score(["foul 1", "fine 1"]).round().tolist() == [1, 0]


def test_op13_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op13_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    held = [(toxic[r["doc_id"]], r["predicted"], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    caught = [p for y, p, _ in held if y == 1]
    clean = [p for y, p, _ in held if y == 0]
    assert np.mean(caught) > 0.8 and np.mean(clean) < 0.01
    ranks = np.argsort(np.argsort([s for _, _, s in held])) + 1
    y = np.array([y for y, _, _ in held])
    assert (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum()) > 0.97
