"""Merge rules on small literal lists: every rule of a snapshot merge, the guards at their limits, edit pairing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollbook.operators import merge

D = dt.date(2026, 1, 10)


def today():
    return F.lit(D)


HIST = "ord long, added date, is_removed boolean, removed date, edited date, edit_of string, replaced_by string"
BASE = f"id string, name string, year int, {HIST}"
SNAP = "id string, name string, year int, src_pos long"


def base(spark, *rows):
    return spark.createDataFrame([(i, n, y, o, a, r is not None, r, None, None, p) for i, n, y, o, a, r, p in rows], BASE)


def run(spark, b, s, **kw):
    kw.setdefault("compare", ["name", "year"])
    rows = merge.snapshot_merge(b, spark.createDataFrame(s, SNAP), today(), **kw)
    return {r["id"]: r for r in rows.collect()}, rows


def test_first_import_is_never_new(spark):
    got, _ = run(spark, spark.createDataFrame([], BASE), [("a", "x", 1, 0)])
    assert got["a"]["added"] is None and got["a"]["status"] == "new"


def test_statuses(spark):
    old = dt.date(2025, 1, 1)
    b = base(spark, ("keep", "k", 1, 0, old, None, None), ("edit", "e", 1, 1, old, None, None), ("gone", "g", 1, 2, old, None, None),
             ("back", "b", 1, 3, old, dt.date(2025, 5, 5), "other"), ("long", "l", 1, 4, old, dt.date(2025, 5, 5), None))
    got, rows = run(spark, b, [("new", "n", 1, 0), ("edit", "E", 1, 1), ("keep", "k", 1, 2), ("back", "b", 1, 3)])
    assert {k: r["status"] for k, r in got.items()} == {
        "keep": "kept", "edit": "edited", "gone": "removed", "back": "returned", "long": "kept", "new": "new"}
    assert got["new"]["added"] == D and got["edit"]["edited"] == D and got["edit"]["name"] == "E" and got["edit"]["added"] == old
    assert got["gone"]["removed"] == D and got["gone"]["is_removed"]
    assert got["back"]["removed"] is None and not got["back"]["is_removed"] and got["back"]["replaced_by"] is None
    assert got["long"]["removed"] == dt.date(2025, 5, 5)
    assert [got[k]["ord"] for k in ("new", "edit", "keep", "back", "gone")] == [0, 1, 2, 3, 2]
    assert merge.merge_counts(rows).first().asDict() == {"added": 1, "removed": 1, "edited": 1, "edits": 0, "returned": 1, "base_rows": 5}


def test_last_duplicate_wins_at_its_own_place(spark):
    got, _ = run(spark, base(spark, ("a", "x", 1, 0, None, None, None)), [("a", "x", 1, 0), ("b", "y", 1, 1), ("a", "z", 1, 2)])
    assert got["a"]["name"] == "z" and got["a"]["ord"] == 2


def test_null_is_missing_but_empty_is_a_change(spark):
    b = base(spark, ("a", None, 1, 0, None, None, None), ("b", None, 1, 1, None, None, None))
    got, _ = run(spark, b, [("a", None, 1, 0), ("b", "", 1, 1)])
    assert got["a"]["status"] == "kept" and got["b"]["status"] == "edited"


def test_without_compare_nothing_is_updated(spark):
    got, _ = run(spark, base(spark, ("a", "x", 1, 0, None, None, None)), [("a", "y", 2, 5)], compare=None)
    assert got["a"]["name"] == "x" and got["a"]["ord"] == 5 and got["a"]["status"] == "kept"


def test_spare_source_removes_and_revives_nothing(spark):
    b = base(spark, ("a", "x", 1, 0, None, None, None), ("r", "y", 1, 1, None, dt.date(2025, 1, 1), None))
    got, _ = run(spark, b, [("r", "y", 1, 0)], primary=False)
    assert got["a"]["status"] == "kept" and not got["a"]["is_removed"] and got["r"]["is_removed"]


@pytest.mark.parametrize(("lost", "verdict"), [(20, "ok"), (21, "too_many_removed")])
def test_removed_guard_at_its_limit(spark, lost, verdict):
    counts = spark.createDataFrame([(0, lost, 100)], "added long, removed long, base_rows long")
    assert merge.merge_guards(counts).first()["verdict"] == verdict
    assert merge.merge_guards(counts, initial=True).first()["verdict"] == "ok"
    assert merge.merge_guards(counts, force=True).first()["verdict"] == verdict


def test_five_percent_and_added_guard(spark):
    counts = spark.createDataFrame([(101, 50, 1000)], "added long, removed long, base_rows long")
    assert merge.merge_guards(counts, max_added=100).first()["verdict"] == "too_many_added"
    assert merge.merge_guards(counts, max_added=100, force=True).first()["verdict"] == "ok"
    counts = spark.createDataFrame([(0, 51, 1000)], "added long, removed long, base_rows long")
    assert merge.merge_guards(counts).first()["verdict"] == "too_many_removed"


def test_edit_keeps_the_first_day_and_links_both_versions(spark):
    old = dt.date(2025, 1, 1)
    b = base(spark, ("a", "константин петров", 1980, 0, old, None, None), ("k", "анна", 1970, 1, old, None, None))
    got, rows = run(spark, b, [("b", "константин петроф", 1980, 0), ("k", "анна", 1970, 1)], rule=merge.year_rule, blocks=merge.year_blocks, max_pairs=60)
    assert got["b"]["added"] == old and got["b"]["edit_of"] == "a" and got["b"]["edited"] == D and got["b"]["status"] == "edit_new"
    assert got["a"]["removed"] == D and got["a"]["replaced_by"] == "b" and got["a"]["status"] == "edit_old"
    counts = merge.merge_counts(rows).first()
    assert (counts["added"], counts["removed"], counts["edits"]) == (0, 0, 1)


def pairs(spark, gone, fresh, **kw):
    g = spark.createDataFrame([(i, n, y, o) for o, (i, n, y) in enumerate(gone)], "id string, name string, year int, base_ord long")
    f = spark.createDataFrame(fresh, "id string, name string, year int")
    rows = merge.pair_edits(g, f, merge.year_rule, merge.year_blocks, **kw).collect()
    return {(r["old_id"], r["new_id"]) for r in rows}


def test_ambiguity_may_end_when_an_earlier_record_takes_a_candidate(spark):
    # o1 fits only n1; o2 fits n1 and n2, so once n1 is taken o2 is left with n2
    gone = [("o1", "aaaaaaaa", 1), ("o2", "aaaaaabb", 1)]
    fresh = [("n1", "aaaaaaab", 1), ("n2", "aaaaccbb", 1)]
    assert pairs(spark, gone, fresh) == {("o1", "n1"), ("o2", "n2")}
    assert pairs(spark, gone[::-1], fresh) == {("o1", "n1")}


def test_two_candidates_are_no_edit_and_many_removed_are_none(spark):
    assert pairs(spark, [("o", "aaaaaaaa", 1)], [("n1", "aaaaaaab", 1), ("n2", "aaaaaaac", 1)]) == set()
    gone = [(f"o{i}", f"{i:02d}" * 6, i) for i in range(3)]
    fresh = [(f"n{i}", f"{i:02d}" * 6, i + 50) for i in range(3)]
    assert len(pairs(spark, gone, fresh, max_pairs=3)) == 3
    assert pairs(spark, gone, fresh, max_pairs=2) == set()


def test_pairs_follow_the_order_as_a_loop_would(spark):
    """Chains of records that wait for each other, ties in the order, and old records that share candidates."""
    import random

    rng = random.Random(7)
    edges = {(o, n) for o in range(60) for n in range(45) if rng.random() < 0.04} | {(100 + i, 200 + j) for i in range(30) for j in (i, i + 1)}
    olds = {o: rng.randint(0, 40) for o, _ in edges}
    used, want = set(), set()
    for o in sorted(olds, key=lambda o: (olds[o], o)):
        free = [n for x, n in sorted(edges) if x == o and n not in used]
        if len(free) == 1:
            used.add(free[0])
            want.add((o, free[0]))
    g = spark.createDataFrame([(o, [n for x, n in edges if x == o], pos) for o, pos in olds.items()], "id long, fits array<long>, base_ord long")
    f = spark.createDataFrame([(n,) for n in {n for _, n in edges}], "id long").withColumn("fits", F.array("id"))
    rule = lambda o, n: F.arrays_overlap(F.col(f"{o}.fits"), F.col(f"{n}.fits"))
    got = merge.pair_edits(g, f, rule, [lambda a: [F.lit(1)]])
    assert {(r["old_id"], r["new_id"]) for r in got.collect()} == want and len(want) > 10


def test_hot_name_drops_only_hopeless_records(spark):
    gone = [("o1", "zzzzzzzz", 1), ("o2", "unique name", 2)]
    fresh = [(f"n{i}", "zzzzzzzz", 100 + i) for i in range(200)] + [("m", "unique name", 3)]
    assert pairs(spark, gone, fresh) == {("o2", "m")}


def test_versioned_list_fills_and_inherits_since(spark):
    b = base(spark, ("a", "константин петров", 1980, 0, None, None, None)).withColumn("since", F.lit("2024-04-04").cast("date"))
    got, _ = run(spark, b, [("b", "константин петроф", 1980, 0), ("n", "new one", 1950, 1)], rule=merge.year_rule, blocks=merge.year_blocks,
                 first_seen=F.lit("2026-01-05").cast("date"))
    assert got["b"]["since"] == dt.date(2024, 4, 4) and got["n"]["since"] == dt.date(2026, 1, 5)


def test_source_that_flags_excluded_records(spark):
    b = base(spark, ("a", "x", 1, 0, None, None, None), ("k", "y", 1, 1, None, None, None))
    s = spark.createDataFrame([("a", "X", 1, True, 0), ("z", "z", 1, True, 1), ("k", "y", 1, None, 2), ("n", "n", 1, False, 3)],
                              "id string, name string, year int, out boolean, src_pos long")
    got = {r["id"]: r for r in merge.merge_with_exclusions(b, s, today(), ["name", "year"]).collect()}
    assert got["a"]["removed"] == D and got["a"]["name"] == "X" and got["a"]["status"] == "removed"
    assert got["z"]["is_removed"] and got["z"]["removed"] is None and got["z"]["added"] is None and got["z"]["status"] == "excluded"
    assert got["n"]["added"] == D and [got[k]["ord"] for k in "azkn"] == [0, 1, 2, 3]


def test_edit_rules(spark):
    cols = "id string, type string, court string, name string, date date, birth string"
    o = spark.createDataFrame([("1", "t", "суд центрального района минска", "длинное название материала номер", None, "01.02.1990")], cols).alias("o")
    n = spark.createDataFrame([("2", "T", "суд центрального района минска от 5", "длинное название материала номер 7", None, "01.02.1990")], cols).alias("n")
    both = o.crossJoin(n)
    r = both.select(merge.titled_rule("o", "n").alias("t"), merge.dated_person_rule("o", "n").alias("p"), merge.birth_rule("o", "n").alias("b")).first()
    assert (r["t"], r["p"], r["b"]) == (True, False, True)
