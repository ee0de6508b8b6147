"""Search by grams: the index and the join against brute force, what they read, and large watchlists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollbook.operators import grams, search, watch
from rollbook.operators.grams import GramIndex, match_by_grams


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


TEXTS = ["abcabc", "xabx", "", "a", "ab", "the cat", "cathe", "ääbä", "a.b*c", None, "日本語😀 x", "😀😀", "the cat", "aaaa" * 5000 + "zzq", "\x00a\x00"]
WORDS = [["a"], ["ab"], ["abc"], ["the"], ["äb"], ["a.b"], ["zz"], ["t c"], ["cat"], ["😀 x"], ["😀"], [""], ["zzq"], ["\x00a"], ["a", "b"], ["the", "cat"], ["the", ""], ["nope", "a"], ["本語", "x"]]


def small(spark):
    ids = [*range(len(TEXTS) - 3), 5, None, 77]
    corpus = spark.createDataFrame([(i, t, "m" if k % 2 else "f") for k, (i, t) in enumerate(zip(ids, TEXTS, strict=True))], "id long, h string, list string")
    variants = spark.createDataFrame([(q, t, w) for q, ws in enumerate(WORDS) for t, w in enumerate(ws)] + [(14, 0, "xabx"), (5, 0, None)], "q int, token_no int, variant string")
    asked = [[{w} for w in ws] for ws in WORDS]
    asked[14][0].add("xabx")

    def want(any_token, keep=lambda k: True):
        test = any if any_token else all
        held = lambda t, token: any(w and w in t for w in token)
        return sorted([(q, i) for q, ws in enumerate(asked) for k, (i, t) in enumerate(zip(ids, TEXTS, strict=True)) if keep(k) and t is not None and test(held(t, token) for token in ws)], key=repr)

    return corpus, variants, want


@pytest.mark.parametrize("any_token", [False, True])
@pytest.mark.parametrize("few", [False, True])
def test_index_and_join_find_what_brute_force_finds(spark, monkeypatch, any_token, few):
    corpus, variants, want = small(spark)
    if few:  # nothing is named in filters, texts and queries are dealt into small groups
        monkeypatch.setattr(grams, "NAMED", 1)
        monkeypatch.setattr(grams, "QUERIES_AT_ONCE", 3)
        monkeypatch.setattr(grams, "CHARS_AT_ONCE", 7)
        monkeypatch.setattr(grams, "SAMPLE", 2)
    index = GramIndex.build(corpus.repartition(3))
    assert rows(index.match(variants, any_token), "q", "id") == want(any_token)
    assert rows(index.match(variants, any_token, where=F.col("list") == "m"), "q", "id") == want(any_token, lambda k: k % 2 == 1)
    assert rows(match_by_grams(corpus, variants, any_token), "q", "id") == want(any_token)
    assert index.match(variants, any_token).columns == ["id", "list", "q"]


def test_empty_corpus_and_no_queries(spark):
    corpus, variants, _ = small(spark)
    none = corpus.limit(0)
    assert GramIndex.build(none).match(variants).collect() == [] and match_by_grams(none, variants).collect() == []
    assert GramIndex.build(corpus).match(variants.limit(0)).collect() == [] and match_by_grams(corpus, variants.limit(0)).collect() == []


def test_only_asked_grams_are_read(spark):
    """The scan names the folders and grams; of the index's files only those of these folders are opened."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(4000)]
    corpus = spark.createDataFrame([(i, " ".join(rng.choices(words, k=40))) for i in range(400)], "id long, h string")
    index = GramIndex.build(corpus)
    asked = spark.createDataFrame([(1, 0, words[5])], "q int, token_no int, variant string")
    wanted = grams.variant_grams(asked).limit(1)
    read = index.read(wanted, ["gram", "docs"])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan and "In(gram" in plan or "EqualTo(gram" in plan
    touched = read.select(F.input_file_name().alias("f")).distinct().collect()
    assert len(touched) == 1 and len(index.grams.inputFiles()) == index.slots
    assert rows(index.match(asked), "id") == rows(corpus.filter(F.contains("h", F.lit(words[5]))), "id")


def test_more_variants_than_fit_in_a_task_are_joined(spark, monkeypatch):
    """Fifty thousand variants, with queries without a token among them; the driver gets neither."""
    rng = random.Random(4)
    letters = "abcdefgh "
    texts = ["".join(rng.choice(letters) for _ in range(300)) for _ in range(60)]
    corpus = spark.createDataFrame(list(enumerate(texts)), "id long, h string")
    asked = [("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))),) for _ in range(50_000)]
    variants = spark.createDataFrame([(q, 0, v[0]) for q, v in enumerate(asked)], "q int, token_no int, variant string")
    always = spark.createDataFrame([(-1,), (-2,), (-3,)], "q int")
    monkeypatch.setattr(search, "BLOCK", 2)
    sent, real = [], search._scan
    monkeypatch.setattr(search, "_scan", lambda corpus, variants, matcher: sent.append(len(matcher.rows)) or real(corpus, variants, matcher))
    got = rows(search.match_queries(corpus, variants, always=always), "q", "id")
    want = {(q, i) for q, (v,) in enumerate(asked) for i, t in enumerate(texts) if v in t} | {(q, i) for q in (-1, -2, -3) for i in range(60)}
    assert got == sorted(want, key=repr) and set(sent) == {0}


def test_staged_search_by_an_index(spark):
    corpus = spark.createDataFrame(
        [(1, "красный болт\nа.б", None, None), (2, "болт красный", None, None), (3, "синий болт", 9, None), (4, "крас", None, 1)],
        "id long, h string, replaced_by long, merged_into long")
    qs = spark.createDataFrame([(1, "красный болт"), (2, "красный болтт"), (3, "синий"), (4, "ничего такого"), (5, " ")], "q int, query string")
    plain = rows(search.staged_search(corpus, qs), "q", "id", "mode")
    assert rows(search.staged_search(GramIndex.build(corpus), qs), "q", "id", "mode") == plain and len(plain) == 6


def test_watchlists_of_any_size(spark, monkeypatch):
    corpus = spark.createDataFrame([("c0", "канал", "c1", None), ("c1", "канал", None, None), ("f", "канал folded", None, "x")], "id string, h string, replaced_by string, merged_into string")
    qs = spark.createDataFrame([(1, "канал"), (2, " "), (3, "kanal folded"), *[(k, f"слово{k}") for k in range(10, 200)]], "q int, query string")
    few = rows(watch.watch_matches(corpus, qs), "q", "id")
    monkeypatch.setattr(search, "BLOCK", 5)
    assert rows(watch.watch_matches(corpus, qs), "q", "id") == few == [(1, "c1"), (1, "f"), (3, "f")]


def test_a_text_meets_a_variant_of_many_queries_once(spark):
    rows = spark.createDataFrame([(d, f"x{d}", f"text {d} alphabeta gammadelta"[: 30 if d % 2 else 16]) for d in range(6)], "_doc long, id string, h string")
    asked = spark.createDataFrame([(q, t, v) for q in range(40) for t, v in ((0, "alphabeta"), (0, "text"), (1, "gammadelta"))], "q int, token_no int, variant string")
    found = spark.createDataFrame([(d, q) for d in range(6) for q in range(40)], "_doc long, q int")
    for any_token, docs in ((True, range(6)), (False, (1, 3, 5))):
        hits = grams.verified(rows, found, asked, any_token)
        got = [tuple(r) for r in hits.collect()]
        assert sorted(got) == sorted((f"x{d}", q) for d in docs for q in range(40))
        assert "collect_set(variant" in hits._jdf.queryExecution().optimizedPlan().toString()


def test_grams_let_pass_are_those_of_the_mask():
    mask = np.zeros(grams.FILTER_BITS, bool)
    every = grams._grams("abcabc дом\ud800")
    mask[every[::3] % (grams.FILTER_BITS - 3)] = True
    assert grams._grams("abcabc дом\ud800", mask).tolist() == [g for g in every.tolist() if mask[g % (grams.FILTER_BITS - 3)]]
