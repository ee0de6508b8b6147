"""Encoding, decoding, counting and packing against the tokenizers library."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from rollbook.llm import packing
from rollbook.llm.bpe import bpe_decode, bpe_encode, vocabulary
from rollbook.llm.queries import QUERIES
from rollbook.llm.unigram import Unigram, read_pieces, token_counts, unigram
from rollbook.llm.words import Words, byte_level_starts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BPE)
    t.no_truncation()
    t.no_padding()
    return t


def as_unigram(pieces):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def little(ids):
    return np.array(ids, "<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab 'strvemld\n\té1½!　 "), max_size=30))
def test_words_are_those_of_the_pattern(text):
    w = Words([text], byte_level_starts)
    got = [w.chars[w.starts[k] : w.starts[k] + w.lengths[k]].tobytes().decode("utf-32-le") for k in w.number]
    assert got == regex.findall(public_tokenizers.PATTERN, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_ids_are_those_of_the_library(library, texts):
    ids, counts = vocabulary(BPE).encode(texts)
    ends = np.cumsum(counts)
    assert [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_a_full_memory_of_words_starts_anew(library, monkeypatch, texts):
    from rollbook.llm import bpe

    monkeypatch.setattr(bpe, "KNOWN_WORDS", 50)
    own = bpe.ByteBpe(BPE)
    for t in texts[5:60]:
        assert own.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_encode_and_decode(spark, frame, texts, empty, library):
    rows = bpe_decode(bpe_encode(frame, BPE), BPE, keep=("id", "ids", "n_tokens")).collect()
    want = sorted((little(library.encode(t or "", add_special_tokens=False).ids), t or "") for t in texts)
    assert sorted((bytes(r["ids"]), r["text"]) for r in rows) == want
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows)
    assert bpe_encode(empty, BPE).collect() == []
    odd = spark.createDataFrame([(1, None), (2, little([172])), (3, little([50256]))], "id long, ids binary")
    assert [r["text"] for r in bpe_decode(odd, BPE).orderBy("id").collect()] == ["", library.decode([172]), "<|endoftext|>"]


def test_op1(spark, sf, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op1_bpe_encode_decode"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(little(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("flat", [False, True], ids=["scores", "ties"])
def test_counts_are_those_of_the_library(texts, flat):
    pieces = [(p, -1.0 if flat else s) for p, s in read_pieces(PIECES)]
    some = [t or "" for t in texts]
    got = Unigram(pieces).count(some)
    assert got.tolist() == [len(x.ids) for x in as_unigram(pieces).encode_batch(some, add_special_tokens=False)]
    again = unigram(PIECES)
    assert again.count(some).tolist() == again.count(some).tolist()


def test_token_counts(spark, frame, texts, empty, sf):
    library = as_unigram(read_pieces(PIECES))
    rows = token_counts(frame, PIECES).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(library.encode(t or "", add_special_tokens=False).ids) for t in texts)
    assert token_counts(empty, PIECES).collect() == []
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op2_token_counts"](spark, sf).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in docs.items()}


def check_packing(rows, docs, library, capacity, end_id):
    """docs: (id, text) pairs; ids may repeat."""
    places, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r[0]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    want = defaultdict(list)
    for k, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end_id]
        edges = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        want[k] += [(i, a, b - a, zlib.crc32(little(ids[a:b]))) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    total = sum(r["length"] for r in rows)
    return len(places), -(-total // capacity)


def test_pack(spark, frame, empty, library, sf):
    docs = [(r["doc_id"], r["text"]) for r in frame.collect()]
    used, least = check_packing(packing.pack(frame, BPE, capacity=32, end_id=7).collect(), docs, library, 32, 7)
    assert used <= least * 1.03 + 1
    assert packing.pack(empty, BPE).collect() == []
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    used, least = check_packing(QUERIES["op3_best_fit_packing"](spark, sf).collect(), docs, library, 1024, 2)
    assert used <= least * 1.03 + 1


def fewest(sizes, capacity):
    """Fewest bins, by trying every way."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=0, max_size=9))
def test_bin_completion_is_near_the_fewest(sizes):
    counts = np.bincount(sizes or [0], minlength=31)
    counts[0] = 0
    for solve in (packing.best_fit, packing.bin_completion):
        fillings = solve(counts, 30)
        assert all(sum(items) <= 30 for _, items in fillings)
        held = sum((n * np.bincount(items, minlength=31) for n, items in fillings), np.zeros(31, int))
        assert held.tolist() == counts.tolist()
    used, best = sum(n for n, _ in fillings), fewest(sorted(sizes, reverse=True), 30)
    assert packing.lower_bound(counts, 30) <= best <= used
    assert sum(n for n, _ in packing.bin_completion(counts, 30, steps=10**6, idle=10**6)) == best  # searched to the end
    assert used <= sum(n for n, _ in packing.best_fit(counts, 30))


def test_bin_completion_beats_best_fit():
    """Best fit takes three sequences where two do."""
    counts = np.bincount([6, 5, 5, 4], minlength=11)
    assert sum(n for n, _ in packing.bin_completion(counts, 10)) == 2
    sizes = np.random.default_rng(2).integers(200, 420, 600)
    counts = np.bincount(sizes, minlength=1025)
    assert sum(n for n, _ in packing.bin_completion(counts, 1024)) < sum(n for n, _ in packing.best_fit(counts, 1024))


def test_completions_are_all_undominated_fillings():
    rng = np.random.default_rng(4)
    for _ in range(40):
        counts, gap = np.zeros(25, np.int64), int(rng.integers(3, 25))
        np.add.at(counts, rng.integers(1, 25, 9), 1)
        got = [tuple(x) for x in packing.completions(counts, gap) if x is not None]
        pieces = [s for s in range(gap, 0, -1) for _ in range(counts[s])]
        every = {tuple(p for i, p in enumerate(pieces) if k >> i & 1) for k in range(1 << len(pieces))}
        every = {x for x in every if sum(x) <= gap}

        def dominated(x):
            subsets = {tuple(p for i, p in enumerate(x) if k >> i & 1) for k in range(1 << len(x))}
            left = {q for q in pieces if pieces.count(q) > x.count(q)}
            return any(sum(s) <= q <= sum(s) + gap - sum(x) and s != (q,) for q in left for s in subsets)

        assert len(got) == len(set(got))
        if counts[gap]:
            assert got == [(gap,)]
        else:
            assert set(got) == {x for x in every if not dominated(x)}
            assert [sum(x) for x in got] == sorted(map(sum, got), reverse=True)


def test_bin_completion_of_smaller_pieces():
    """Long pieces of many lengths go with two smaller ones each, not with each other."""
    counts = np.zeros(1025, np.int64)
    counts[470:501], counts[262] = 10, 620
    assert sum(n for n, _ in packing.bin_completion(counts, 1024)) <= 312
