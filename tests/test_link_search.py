"""Linking, chains, spelling, matching and ranges on small literal frames."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollbook.functions.spelling import query_tokens, token_variants
from rollbook.operators import link, search, watch


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_fold_prefers_exact_and_claims_once(spark):
    cols = "id string, name string, birth string, ord long"
    p = spark.createDataFrame([("p1", "a", "01.02.1990", 1), ("p2", "a", "01.03.1990", 2), ("p3", "b", "", 3), ("p4", "c", "05.05.1955", 4)], cols)
    t = spark.createDataFrame([("t1", "a", "01.03.1990", 1), ("t2", "a", "01.03.1990", 2), ("t3", "b", "", 3), ("t4", "c", "05.05.1956", 4), ("t5", "c", "06.06.1955", 5)], cols)
    # t1 takes p2 (equal) although p1 is near; t2's best is taken, so it stays alone; an empty birth proves nothing
    assert rows(link.fold_lists(p, t), "id", "merged_into") == {("t1", "p2"), ("t4", "p4")}


def test_fold_with_a_hot_name(spark):
    p = spark.range(2000).select(F.concat(F.lit("p"), "id").alias("id"), F.lit("same").alias("name"), F.lit("01.01.1970").alias("birth"), F.col("id").alias("ord"))
    t = p.withColumn("id", F.concat(F.lit("t"), "id"))
    assert rows(link.fold_lists(p, t), "id", "merged_into") == {("tp0", "p0")}


def test_cross_links_count_both_sides_and_aliases(spark):
    p = spark.createDataFrame([(1, "ann", "1980"), (2, "ann", "1980"), (3, "bob", "1990")], "id long, name string, year string")
    w = spark.createDataFrame([(10, "ann", ["anna", "ann"], "1980"), (11, "x", ["bob", "ann"], "1990"), (12, "ann", None, "1981")], "id long, name string, aliases array<string>, year string")
    assert rows(link.cross_links(p, w), "list", "id", "links", "first_link") == {
        ("p", 1, 1, 10), ("p", 2, 1, 10), ("p", 3, 1, 11), ("w", 10, 2, 1), ("w", 11, 1, 3)}
    asked = spark.createDataFrame([(1,)], "id long")
    assert rows(link.links_of(asked, p, w), "person_id", "wanted_id") == {(1, 10)}


def test_chain_bound_and_cycle(spark):
    edges = spark.createDataFrame([(f"c{i}", f"c{i - 1}") for i in range(1, 11)] + [("x", "y"), ("y", "x"), ("s", "s")], "id string, edit_of string")
    got = {r["id"]: (r["path"], r["root"]) for r in link.chain_paths(edges).collect()}
    assert got["c9"][0] == ["c9", "c8", "c7", "c6", "c5", "c4", "c3", "c2"] and got["c9"][1] == "c1"
    assert set(got["c3"][0]) == {"c3", "c2", "c1", "c0"} and got["c3"][1] == "c0"
    assert set(got["x"][0]) == {"x", "y"} and got["x"][1] == "x" and got["s"][1] == "s"
    match = spark.createDataFrame([("q", "c9")], "q string, id string")
    for seen, hit in (("c9", 1), ("c2", 1), ("c1", 0), ("c0", 0)):
        known = spark.createDataFrame([("q", seen)], "q string, id string")
        assert link.seen_via_chain(match, edges, known).count() == hit


def variants(spark, token):
    return spark.createDataFrame([(token,)], "t string").select(token_variants(F.col("t")).alias("v")).first()["v"]


def test_spelling_variants(spark):
    assert "наша" in variants(spark, "naša") and "воўк" in variants(spark, "voŭk") and "жодзіна" in variants(spark, "žodzіna")
    assert {"grodna", "hrodna"} <= set(variants(spark, "гродна")) and {"zhodzіna", "zodzіna"} <= set(variants(spark, "жодзіна"))
    assert {"syamya", "sjamja"} <= set(variants(spark, "сям'я")) and "конь" in variants(spark, "kon'")
    for alone in ("ab", "да", "ьыь", "abcд", "2026", "t.me/x"):
        assert variants(spark, alone) == [alone]
    assert variants(spark, "і") == ["і", "и"] and variants(spark, "и") == ["и", "і"]
    got = variants(spark, "мінск")
    assert got[0] == "мінск" and len(set(got)) == len(got) and {"минск", "mіnsk"} <= set(got)


def test_one_pass_respelling_is_not_chained_replacing(spark):
    assert "ащб" in variants(spark, "ashchb")
    got = variants(spark, "atshch")
    assert "ацхч" in got and "атщ" not in got


def test_query_tokens(spark):
    df = spark.createDataFrame([('  https://t.me/foo/ "Two  words" @bar, www.x.by. "" Ёлка!? ',), ("   ",), ("@",)], "s string")
    got = [r["t"] for r in df.select(query_tokens(F.col("s")).alias("t")).collect()]
    assert got[0] == ["t.me/foo", "two words", "bar", "x.by", '""', "елка"] and got[1] == [] and got[2] == ["@"]


def corpus(spark):
    return spark.createDataFrame(
        [(1, "красный болт\nа.б", None, None), (2, "болт красный", None, None), (3, "синий болт", 9, None), (4, "крас", None, 1)],
        "id long, h string, replaced_by long, merged_into long")


def test_matching_agrees_with_brute_force_in_any_number_of_blocks(spark, monkeypatch):
    texts = ["abcabc", "xabx", "", "a", "ab", "the cat", "cathe", "ääbä", "a.b*c"]
    words = ["a", "ab", "abc", "the", "äb", "a.b", "zz", "t c", "cat"]
    texts += ["the cat", None]  # a repeated and an empty id, and a row without a text
    ids = [*range(9), 5, None]
    c = spark.createDataFrame(list(zip(ids, texts, strict=True)), "id long, h string")
    v = spark.createDataFrame([(q, t, w) for q, ws in enumerate([[w] for w in words] + [["a", "b"], ["the", "cat"]]) for t, w in enumerate(ws)], "q int, token_no int, variant string")
    want_all = {(q, i) for q, ws in enumerate([[w] for w in words] + [["a", "b"], ["the", "cat"]]) for i, t in zip(ids, texts, strict=True) if t is not None and all(w in t for w in ws)}
    want_any = {(q, i) for q, ws in enumerate([[w] for w in words] + [["a", "b"], ["the", "cat"]]) for i, t in zip(ids, texts, strict=True) if t is not None and any(w in t for w in ws)}
    every = spark.createDataFrame([(99,)], "q int")
    for block in (1000, 4):
        monkeypatch.setattr(search, "BLOCK", block)
        assert rows(search.match_queries(c, v), "q", "id") == want_all
        assert rows(search.match_queries(c, v, any_token=True), "q", "id") == want_any
        assert search.match_queries(c, v).filter("q = 3 and id = 5").count() == 2
        assert search.match_queries(c, v, always=every).filter("q = 99").count() == len(texts)


def test_staged_search_tries_similar_words_only_without_exact_hits(spark):
    qs = spark.createDataFrame([(1, "красный болт"), (2, "красный болтт"), (3, "синий"), (4, "ничего такого"), (5, " ")], "q int, query string")
    got = rows(search.staged_search(corpus(spark), qs), "q", "id", "mode")
    assert got == {(1, 1, "exact"), (1, 2, "exact"), (2, 1, "fuzzy"), (2, 2, "fuzzy"), (5, 1, "exact"), (5, 2, "exact")}


def test_facets_count_untagged_rows_and_live_rows_of_an_empty_query(spark):
    c = spark.createDataFrame(
        [(1, "red", None, None, "m", None), (2, "red", None, None, None, None), (3, "red", None, None, "f", None), (4, "blue", None, None, "m", "1999-01-01")],
        "id long, h string, replaced_by long, merged_into long, list string, removed string")
    qs = spark.createDataFrame([(1, "red"), (2, " "), (3, "blue")], "q int, query string")
    got = {r["q"]: (r["n_all"], r["n_m"], r["n_f"], r["view_n"]) for r in search.search_facets(c, qs, ["m", "f"], "m").collect()}
    assert got == {1: (3, 2, 1, 2), 2: (3, 2, 1, 2), 3: (1, 1, 0, 1)}


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_similar_words_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    words = list({"".join(rnd.choice("абв") for _ in range(rnd.randint(3, 10))) for _ in range(400)})
    words += ["".join(rnd.choice("аб") for _ in range(rnd.randint(12, 19))) for _ in range(250)]
    for w in words[-60:]:  # near ones, with letters put in, left out and changed
        i, j = sorted(rnd.sample(range(len(w)), 2))
        words += [w[:i] + w[i + 1 :], w[:i] + "в" + w[i:j] + "в" + w[j + 1 :], w[:i] + w[i + 1 : j] + "аб" + w[j:]]
    words = list(set(words))
    tokens = rnd.sample(words, 120) + ["абвабвабвабв", "аб", "а" * 900]
    k = lambda t: 2 if len(t) >= 8 else 1 if len(t) >= 5 else 0
    want = {(t, w) for t in tokens for w in words if k(t) and w != t and lev(t, w) <= k(t)}
    got = search.similar_words(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(w,) for w in words], "word string"))
    assert rows(got, "token", "word") == want


def test_match_ranges_merge_touching_and_overlapping(spark):
    t = spark.createDataFrame([(1, 1, "Аба абаба xx ab"), (2, 1, "aaaa")], "id long, q int, text string")
    v = spark.createDataFrame([(1, 0, "аба"), (1, 0, "ба"), (1, 1, "x"), (1, 2, "aa"), (1, 3, ".")], "q int, token_no int, variant string")
    got = rows(search.match_ranges(t, v), "id", "start", "stop")
    assert got == {(1, 0, 3), (1, 4, 9), (1, 10, 12), (2, 0, 4)}


def test_watch_reports_only_unseen(spark):
    c = spark.createDataFrame([("c0", "канал", "c1", None), ("c1", "канал", None, None), ("f", "канал folded", None, "x")], "id string, h string, replaced_by string, merged_into string")
    qs = spark.createDataFrame([(1, "канал"), (2, " ")], "q int, query string")
    m = watch.watch_matches(c, qs)
    assert rows(m, "q", "id") == {(1, "c1"), (1, "f")}
    edges = spark.createDataFrame([("c1", "c0")], "id string, edit_of string")
    seen = spark.createDataFrame([(1, "c0")], "q int, id string")
    assert rows(watch.watch_fresh(m, seen, edges), "q", "id") == {(1, "f")}


def test_a_scan_holds_few_texts_and_pairs_at_a_time():
    class Seen(search.Matcher):
        def match(self, text):
            return list(range(500)) if text else []

    texts = pa.array([f"t{i}" if i % 3 else None for i in range(1500)])
    batches = [pa.RecordBatch.from_arrays([pa.array(range(1500)), texts], ["id", "h"]), pa.RecordBatch.from_arrays([pa.array([7]), pa.array([""])], ["id", "h"])]
    out = list(search._matched(Seen([], {}, [], False), batches, ["id"], pa.int64()))
    assert max(b.num_rows for b in out) <= search.PAIRS_AT_ONCE + 500
    assert sum(b.num_rows for b in out) == 1000 * 500
    assert {i for b in out for i in b.column(0).to_pylist()} == {i for i in range(1500) if i % 3}


def test_links_of_gives_pairs_once_without_gathering_them(spark):
    p = spark.createDataFrame([(i, n, y) for i in range(6) for n, y in (("a", 1), ("b", 1), ("c", None))[: 1 + i % 3]], "id int, name string, year int")
    w = spark.createDataFrame([(10, "a", ["b", "c"], 1), (11, "b", None, 1), (12, "c", ["a"], None), (13, "", ["a", "a"], 1)], "id int, name string, aliases array<string>, year int")
    asked = spark.createDataFrame([(i,) for i in (0, 1, 1, 2, 5, 9)], "id int")
    found = link.links_of(asked, p, w)
    got = [tuple(r) for r in found.select("person_id", "wanted_id").collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i in (0, 1, 2, 5) for j in (10, 13)} | {(i, 11) for i in (1, 2, 5)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


@pytest.mark.parametrize("block", [100_000, 40, 4])  # sets of tokens are sent from the driver, found by Spark, joined by grams
@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_queries_that_ask_for_the_same_are_looked_for_once(spark, monkeypatch, block, sent):
    texts = [(1, "alpha beta gamma"), (2, "beta"), (2, "beta"), (None, "gamma alpha"), (4, None), (5, ""), (6, "delta бета")]
    asked = [[["alpha"], ["gamma"]], [["beta", "бета"]], [["gamma"], ["alpha"], ["gamma"]], [["zeta"]], [["beta"], [""]], [["бета", "beta"]], [["delta"]]]
    queries = [(q if q else None, asked[q % 6] if q < 60 else asked[6]) for q in range(61)]
    c = spark.createDataFrame(texts, "id long, h string")
    v = spark.createDataFrame([(q, t, w) for q, ts in queries for t, ws in enumerate(ts) for w in ws], "q int, token_no int, variant string")
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "SENT", sent, raising=False)
    monkeypatch.setattr(search, "SHARE", 3, raising=False)
    looked, made, joined = [], search.Matcher.__init__, search.match_by_grams
    monkeypatch.setattr(search.Matcher, "__init__", lambda self, rows, *a: looked.append(len(rows)) or made(self, rows, *a))
    monkeypatch.setattr(search, "match_by_grams", lambda corpus, asked, *a: looked.append(asked.filter("variant <> ''").count()) or joined(corpus, asked, *a))
    for any_token, test in ((False, all), (True, any)):
        want = Counter((q, i) for q, ts in queries for i, h in texts if h is not None and test(any(w and w in h for w in ws) for ws in ts))
        assert Counter((r["q"], r["id"]) for r in search.match_queries(c, v, any_token).collect()) == want and want[None, None] == 1
    assert looked == [7, 7]  # variants of five sets of tokens, however many queries; "zeta" is one of them


def test_queries_of_a_share_stand_together_in_the_result():
    found = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([i % 3 for i in range(3000)], pa.int64())], ["id", "q"])
    out = list(search._by_share(found, {0: 1, 1: 200, 2: 7}))
    assert max(b.num_rows for b in out) <= search.PAIRS_AT_ONCE and len(out) == 3
    got = [r for b in out for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert got == [(i, k, s) for k, n in enumerate((1, 200, 7)) for s in range(n) for i in range(k, 3000, 3)]
    assert list(search._by_share(found.slice(0, 0), {})) == []
