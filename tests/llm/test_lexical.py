"""Ranked search against scoring every pair in Python integers."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from compare import compare, oracle
from rollbook.llm import lexical
from rollbook.llm.lexical import impacts, ranked_search
from rollbook.llm.queries import ORACLES, QUERIES
from rollbook.llm.terms import Runs, Terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(items, docs, k=10):
    """All scores of all pairs; rows (item_id, rank, doc_id, score)."""
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        asked = Counter(terms_of(text))
        scores = []
        for i, b, n in bags:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t, c in asked.items() if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def got(items, docs, **options):
    return sorted([tuple(r) for r in ranked_search(items, docs, **options).select("item_id", "rank", "doc_id", "score").collect()], key=repr)


def made(n, seed, words=300):
    """Texts of very different lengths over words of very different frequencies, copies among them."""
    rng = random.Random(seed)
    pool = [f"{c}{k}" for k in range(words) for c in ("w", "É", "日")]
    texts = [" ".join(pool[min(int(rng.paretovariate(0.7)), len(pool)) - 1] for _ in range(int(rng.paretovariate(0.8) * 5) % 900)) for _ in range(n)]
    return texts + rng.choices(texts, k=n // 4) + [texts[0]] * 40


@pytest.fixture(scope="module")
def library():
    docs = [(k if k % 31 else None, t) for k, t in enumerate(made(700, 1))]
    docs += [(5000, None), (5001, ""), (5002, "!! ?? \n"), (5003, "W1 w1 É1 é1"), (5004, "q" * 300_000 + " w5 " * 9), (5005, "w7 " * 400_000), (5006, docs[7][1]), (5006, docs[7][1])]
    items = [(k % 50, t[:400]) for k, t in enumerate(made(60, 2))] + [(100, None), (101, ""), (102, "nothingofthis"), (103, "W5"), (104, "w1 w1 w1 W1 w2"), (None, "w9 w8"), (105, "w7 " * 50), (103, "W5")]
    return items, docs


@pytest.fixture(scope="module")
def frames(spark, library):
    items, docs = library
    return (
        spark.createDataFrame([(*r, 1, 2.0, "x") for r in items], "item_id long, text string, doc_id long, score double, rank string"),
        spark.createDataFrame([(*r, 1, 2.0, "x") for r in docs], "doc_id long, text string, id long, n double, item_id string").repartition(3),
    )


def test_results_are_those_of_all_pairs(frames, library):
    assert got(*frames) == plain(*library)


def test_small_buckets_and_chunks_prune_nothing_that_counts(frames, library, monkeypatch):
    monkeypatch.setattr(lexical, "BUCKET", 8)
    monkeypatch.setattr(lexical, "DOCUMENTS", 100)
    assert got(*frames, k=3) == plain(*library, k=3)


def test_several_passes(frames, library):
    assert got(*frames, item_chars=3000) == plain(*library)


def test_buckets_and_coordinates_are_pruned(library):
    """Of an item's postings only some are read once its tenth best score is known, and short buckets not at all."""
    rng = np.random.default_rng(3)
    n, terms = 4000, 200
    term = np.sort(rng.permuted(np.tile(np.arange(terms), (n, 1)), axis=1)[:, :20], axis=1)
    size = np.sort(rng.integers(10_000, 900_000, n))[::-1]
    impact = np.repeat(size, 20).reshape(n, 20)
    ptr = np.arange(n + 1) * 20
    norm = np.sqrt((impact.astype(float) ** 2).sum(axis=1))
    asked = np.array([3, 50, 120]), np.array([9000.0, 300.0, 200.0])
    rest = np.sqrt(np.append(np.cumsum((asked[1] ** 2)[::-1])[::-1], 0))
    want = np.zeros(n, np.int64)
    for t, q in zip(*asked, strict=True):
        want += np.where(term == t, int(q) * impact, 0).sum(axis=1)
    least, found, read = 0, [], 0
    for a in range(0, n, 256):
        bucket = lexical.Bucket(np.arange(a, min(n, a + 256)), ptr, term.ravel(), impact.ravel(), norm)
        got = bucket.search((*asked, rest), least)
        if got is None:
            break
        read += 1
        found += [(int(s), a + int(d)) for d, s in zip(*got, strict=True)]
        least = sorted(found)[-10][0] if len(found) >= 10 else 0
    assert sorted(found)[-10:] == sorted(zip(want.tolist(), range(n), strict=True))[-10:]
    assert read < 15 and len(found) < 300  # of 16 buckets and 4000 documents


def test_no_items_or_no_documents(spark, frames):
    items, docs = frames
    none_of = spark.createDataFrame([], "item_id long, text string")
    no_docs = spark.createDataFrame([], "doc_id long, text string")
    assert got(none_of, docs) == [] and got(items, no_docs) == []
    assert ranked_search(none_of, docs).columns == ["item_id", "rank", "doc_id", "score"]
    assert got(items, spark.createDataFrame([(1, None), (2, "?")], "doc_id long, text string")) == []


def test_string_ids_and_other_names(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z")], "k string, body string")
    items = spark.createDataFrame([("q", "x")], "name string, ask string")
    rows = ranked_search(items, docs, item_id="name", item_text="ask", id_col="k", text_col="body").orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == ["a", "b", None] and [r["rank"] for r in rows] == [1, 2, 3]


def test_large_numbers_divide_exactly():
    n = np.array([1, 10**9, 2 * 10**9])
    got = impacts(np.array([1, 5, 7]), n, 10**10, 3 * 10**12)
    want = [1_000_000_000 * t // (1000 * t + 8 * (25 + 75 * int(x) * 10**10 // (3 * 10**12))) for t, x in zip([1, 5, 7], n, strict=True)]
    assert got.tolist() == want


def test_terms_that_share_a_hash(monkeypatch):
    from rollbook.llm import terms

    monkeypatch.setattr(terms, "hash_runs", lambda chars, s, e: np.full(len(s), 7, np.uint64))
    known = Terms(Runs(["b a c a"]))
    assert known.number.tolist() == [0, 1, 2, 1] and known.find(Runs(["c", "x A", ""])).tolist() == [2, -1, 1]


def test_op12(spark, sf):
    assert compare(spark, oracle(sf), sf, "op12", QUERIES["op12_ranked_search"], ORACLES["op12_ranked_search"]) is None
