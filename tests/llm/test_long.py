"""Texts longer than what a task takes at once, and words longer than a slice, through the operators on whole texts."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rollbook.llm import words
from rollbook.llm.near import near_duplicates
from rollbook.llm.packing import pack
from rollbook.llm.quality import classify, fit_classifier
from rollbook.llm.rules import quality_ledger
from test_filters import ledger_truth

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text of 1.3 million characters, nearly the same again, one of a single word of 300,000 letters, and one that ends in it."""
    rng = random.Random(21)
    pool = ["tree", "river,", "naïve", "日本", "stone", "walks", "bright.", "morning", "found"]
    body = [rng.choice(pool) + (str(k) if k % 7 == 0 else "") for k in range(220_000)]
    near = body[:1000] + ["other"] + body[1001:]
    word = "".join(rng.choice("abcdefgh") for _ in range(300_000))
    texts = [" ".join(body), "\n".join(near), word, "short words and then " + word, "", None]
    assert len(texts[0]) > words.CHARS_AT_ONCE and len(word) > words.SLICE
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()


def test_long_texts_are_packed_whole(long_docs):
    texts, docs = long_docs
    library = Tokenizer.from_file(BPE)
    rows = pack(docs, BPE).collect()
    for i, t in enumerate(texts):
        own = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["id"] == i)
        total = len(library.encode(t or "", add_special_tokens=False).ids) + 1
        assert sum(n for _, _, n in own) == total and len(own) == -(-total // 1024) and [s for _, s, _ in own] == [sum(n for _, _, n in own[:k]) for k in range(len(own))]


def test_long_texts_are_linked(long_docs):
    _, docs = long_docs
    assert {r["id"]: r["component_id"] for r in near_duplicates(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5}


def test_long_texts_are_measured_and_scored(long_docs):
    texts, docs = long_docs
    got = {r["id"]: tuple(r)[1:] for r in quality_ledger(docs.where("doc_id <> 0 AND doc_id <> 1")).collect()}
    assert got == {i: ledger_truth(t) for i, t in enumerate(texts) if i > 1}
    rows = {r["id"]: (r["n_words"], r["word_chars"]) for r in quality_ledger(docs.where("doc_id < 2")).collect()}
    assert rows == {i: (len(texts[i].split()), sum(map(len, texts[i].split()))) for i in (0, 1)}
    scored = {r["id"]: r["score"] for r in classify(docs, fit_classifier(docs)).collect()}
    assert len(scored) == 6 and all(0 <= s <= 1 for s in scored.values()) and scored[4] == scored[5] == 0
