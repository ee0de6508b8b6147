"""Words that hashes might take for each other, words longer than a slice and texts longer than a group."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from rollbook.llm import bpe, words
from rollbook.llm.bpe import ByteBpe, bpe_encode
from rollbook.llm.near import near_duplicates
from rollbook.llm.packing import pack
from rollbook.llm.shingles import shingle_sets
from rollbook.llm.unigram import Unigram, read_pieces
from rollbook.llm.words import Words, hash_runs

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def twins(n):
    """The Thue-Morse word of n letters and its complement: equal under any hash by powers modulo 2**64 if n is 1024 or more."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def unigram_library():
    t = Tokenizer(models.Unigram(read_pieces(PIECES), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def ids_of(vocabulary, texts):
    ids, counts = vocabulary.encode(texts)
    ends = np.cumsum(counts)
    return [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)]


def want(library, texts):
    return [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_twins_have_their_own_ids_counts_and_sets(library, unigram_library, n):
    a, b = twins(n)
    assert len(set(hash_runs(np.frombuffer((a + b).encode("utf-32-le"), np.uint32), np.array([0, n]), np.array([n, 2 * n])).tolist())) == 2
    assert ids_of(ByteBpe(BPE), [a, b]) == want(library, [a, b])  # in one group
    apart = ByteBpe(BPE)
    assert [ids_of(apart, [t])[0] for t in (a, b, a)] == want(library, [a, b, a])  # against known words
    assert Unigram(read_pieces(PIECES)).count([a, b]).tolist() == [len(x) for x in want(unigram_library, [a, b])]
    sets, counts = shingle_sets([a, b, a.upper()])
    assert counts.tolist() == [1, 1, 1] and sets[0] != sets[1] and sets[0] == sets[2]


def test_twins_are_not_linked(spark):
    a, b = twins(4096)
    got = near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")).orderBy("id").collect()
    assert [r["component_id"] for r in got] == [1, 2, 1]


def test_twins_are_packed_by_their_own_ids(spark, library):
    a, b = twins(2048)
    got = {r["id"]: r["n"] for r in pack(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"), BPE, capacity=1024, end_id=2).groupBy("id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert got == {1: len(want(library, [a])[0]) + 1, 2: len(want(library, [b])[0]) + 1}


@pytest.mark.parametrize("same", [lambda n: np.zeros(n, np.uint64), lambda n: np.arange(n, dtype=np.uint64) % np.uint64(3)])
def test_results_do_not_rest_on_hashes(monkeypatch, library, unigram_library, texts, same):
    """Every word hashed to one of a few numbers, or all to one."""
    monkeypatch.setattr(words, "hash_runs", lambda chars, starts, ends: same(len(starts)))
    texts = [t or "" for t in texts[:60]]
    plain = [t for t in texts if "<|endoftext|>" not in t]
    vocabulary, model = ByteBpe(BPE), Unigram(read_pieces(PIECES))
    for group in (plain[:10], plain[5:30], plain):
        assert ids_of(vocabulary, group) == want(library, group)
        assert model.count(group).tolist() == [len(x.ids) for x in unigram_library.encode_batch(group, add_special_tokens=False)]


def test_memory_that_is_full_all_the_time(monkeypatch, library, texts):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 7)
    vocabulary = ByteBpe(BPE)
    for at in range(0, len(texts), 9):
        group = [t or "" for t in texts[at : at + 9]]
        assert ids_of(vocabulary, group) == want(library, group)


@pytest.fixture(scope="module")
def long_texts():
    """A word longer than a slice, one of exactly a slice, and a text longer than a group."""
    rng = random.Random(8)
    word = "".join(rng.choice("abcdeé") for _ in range(words.SLICE + 12_345))
    return [word, word[: words.SLICE], "so " + word + " it", " ".join(rng.choice(["tree", "of", "naïve", "12", "日本"]) for _ in range(300_000)), ""]


def test_long_words_and_texts(library, unigram_library, long_texts, spark):
    assert len(long_texts[0]) > words.SLICE and len(long_texts[3]) > words.CHARS_AT_ONCE
    assert ids_of(ByteBpe(BPE), long_texts) == want(library, long_texts)
    assert Unigram(read_pieces(PIECES)).count(long_texts).tolist() == [len(x.ids) for x in unigram_library.encode_batch(long_texts, add_special_tokens=False)]
    frame = spark.createDataFrame(list(enumerate(long_texts)), "doc_id long, text string")
    got = {r["id"]: hashlib.sha256(r["ids"]).hexdigest() for r in bpe_encode(frame, BPE).collect()}
    assert got == {i: hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for i, x in enumerate(want(library, long_texts))}


def test_long_words_are_hashed_part_by_part():
    """As a whole, in one slice with others, and cut by slices."""
    rng = np.random.default_rng(5)
    chars = rng.integers(97, 123, 3 * words.SLICE).astype(np.uint32)
    ends = np.array([10, 10 + 2 * words.SLICE + 7, len(chars)])
    starts = np.array([0, 10, ends[1]])
    got = hash_runs(chars, starts, ends)
    again = [hash_runs(chars[s:e], np.array([0]), np.array([e - s]))[0] for s, e in zip(starts, ends, strict=True)]
    assert got.tolist() == [int(x) for x in again] and len(set(got.tolist())) == 3
    small = hash_runs(chars, np.array([0, 3, 8]), np.array([3, 5, 20]))
    assert small.tolist() == [int(hash_runs(chars[s:e], np.array([0]), np.array([e - s]))[0]) for s, e in ((0, 3), (3, 5), (8, 20))]


def test_words_with_gaps_between(texts):
    raw = np.frombuffer("a bb  ccc a bb".encode("utf-32-le"), np.uint32)
    h = hash_runs(raw, np.array([0, 2, 6, 10, 12]), np.array([1, 4, 9, 11, 14]))
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3
    assert len(Words(["a a b"], lambda c, f: f | (c == 32)).starts) == 3
