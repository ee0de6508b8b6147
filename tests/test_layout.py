"""Lists in buckets, files by chunk and by id, totals by rollup, ranges in one pass, and keyed standing queries."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rollbook.operators import changes, merge, search
from rollbook.session import work_dir
from rollbook.sources.buckets import BucketedList, merge_incremental
from rollbook.sources.publish import GuardError, lookup_by_id, read_chunks, write_by_id, write_chunks
from rollbook.streaming import eventtime

D = dt.date(2026, 1, 10)
HISTORY = "ord long, added date, is_removed boolean, removed date, edited date, edit_of string, replaced_by string"
SCHEMA = f"id string, name string, year int, {HISTORY}"


def base(spark, n):
    return spark.createDataFrame([(f"r{i:04d}", f"name number {i:04d}", 1900 + i % 90, i, dt.date(2020, 1, 1), i % 17 == 0, D if i % 17 == 0 else None, None, None, None) for i in range(n)], SCHEMA)


def snapshot(spark, n, gone=(), edited=(), extra=(), renamed=()):
    rows = []
    for i in range(n):
        if i % 17 == 0 or i in gone:
            continue
        if i in renamed:
            rows.append((f"x{i:04d}", f"nbme number {i:04d}", 1900 + i % 90, i))
        else:
            rows.append((f"r{i:04d}", f"name number {i:04d}" + (" changed" if i in edited else ""), 1900 + i % 90, i))
    return spark.createDataFrame(rows + [(e, "entirely new", 1, 10**6 + k) for k, e in enumerate(extra)], "id string, name string, year int, src_pos long")


def all_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_incremental_merge_is_the_merge_and_leaves_other_buckets_alone(spark):
    n = 600
    kept = BucketedList(spark, work_dir(spark, "list"), SCHEMA, buckets=32)
    kept.publish(base(spark, n))
    whole = base(spark, n)
    options = {"rule": merge.year_rule, "blocks": merge.year_blocks}
    steps = [dict(edited=[5]), dict(edited=[5], gone=[40], extra=["new"]), dict(edited=[5], extra=["new"], renamed=[100]), dict(edited=[5], extra=["new"], renamed=[100])]
    names = whole.columns
    for k, step in enumerate(steps):
        snap = snapshot(spark, n, **step)
        paths = kept.paths()
        changed, touched = merge_incremental(kept, snap, F.lit(D), ["name", "year"], initial=False, **options)
        merged = merge.snapshot_merge(whole, snap, F.lit(D), ["name", "year"], initial=False, **options)
        assert all_rows(kept.read().select(names)) == all_rows(merged.select(names))
        want = [r for r in all_rows(merged.select("id", "status")) if r[1] != "kept"]
        assert [r for r in all_rows(changed.select("id", "status")) if r[1] != "kept"] == want
        after = kept.paths()
        assert {b for b in after if after[b] != paths.get(b)} == set(touched) and len(touched) <= 3
        whole = spark.createDataFrame(merged.select(names).collect(), SCHEMA)
        assert kept.version() == k + 2
    assert touched == []  # the same snapshot again
    assert all_rows(kept.read(version=1).select(names)) == all_rows(base(spark, n))
    assert kept.forget_before(kept.version()) > 0 and kept.read().count() == whole.count()


def test_guards_tags_and_emptied_buckets(spark):
    kept = BucketedList(spark, work_dir(spark, "list"), SCHEMA, buckets=4)
    assert kept.version() == 0 and kept.read().count() == 0
    merge_incremental(kept, snapshot(spark, 100), F.lit(D), ["name"], tag="a", initial=True)
    assert kept.version() == 1 and kept.read().count() == 94
    again, touched = merge_incremental(kept, snapshot(spark, 100, gone=range(1, 90)), F.lit(D), ["name"], tag="a")
    assert touched == [] and kept.version() == 1
    judge = lambda counts: merge.merge_guards(counts)
    with pytest.raises(GuardError, match="too_many_removed"):
        merge_incremental(kept, snapshot(spark, 100, gone=range(1, 90)), F.lit(D), ["name"], judge=judge)
    assert kept.version() == 1 and not kept.read().filter("is_removed").count()
    kept.publish(base(spark, 1))
    assert kept.read().count() == 1 and BucketedList(spark, kept.root, SCHEMA).buckets == 4
    kept.publish(base(spark, 0))
    assert kept.read().count() == 0


def files_read(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_chunks_and_ids_are_read_from_their_folders(spark):
    n = 5000
    rows = spark.range(n).select(F.concat(F.lit("k"), "id").alias("id"), (F.lit(n) - F.col("id")).alias("turn"))
    path = work_dir(spark, "chunks")
    write_chunks(rows, [F.col("turn")], path, size=20, chunks=10)
    asked = spark.createDataFrame([(3,), (3,), (249,), (999,)], "chunk long")
    got = read_chunks(asked, path, chunks=10)
    assert sorted((r["chunk"], r["pos"], r["turn"]) for r in got.collect()) == [(p // 20, p, p + 1) for p in [*range(60, 80), *range(4980, 5000)]]
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString().lower()
    assert len(files_read(got)) <= 2 and len(spark.read.parquet(path).inputFiles()) >= 25

    path = work_dir(spark, "ids")
    write_by_id(rows, path, shelves=40)
    ask = spark.createDataFrame([(1, "k7"), (2, "k7"), (3, "nope"), (4, None)], "n long, id string")
    found = lookup_by_id(ask, path, shelves=40)
    assert sorted((r["n"], r["turn"], r["stale"]) for r in found.collect()) == [(1, n - 7, False), (2, n - 7, False), (3, None, True), (4, None, True)]
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()


def test_rollups_tell_totals_from_missing_values(spark):
    rows = spark.createDataFrame([("m", 2000, 1), ("m", 2000, 2), ("m", None, 3), (None, 2000, 4)], "list string, year int, v int")
    got = {(r["list"], r["year"], r["level"]): (r["n"], r["top"]) for r in search.facet_rollup(rows, ["list", "year"], {"top": F.max("v")}).collect()}
    assert got == {("m", 2000, 0): (2, 2), ("m", None, 0): (1, 3), (None, 2000, 0): (1, 4), ("m", None, 1): (3, 3), (None, None, 1): (1, 4), (None, None, 3): (4, 4)}
    fresh = spark.createDataFrame([("m", D), ("m", D), ("f", None)], "list string, added date")
    got = {(r["list"], r["added"], r["level"]): (r["n"], r["last_added"]) for r in changes.digest_rollup(fresh).collect()}
    assert got == {("m", D, 0): (2, D), ("f", None, 0): (1, None), ("m", None, 1): (2, D), ("f", None, 1): (1, None), (None, None, 3): (3, D)}


@pytest.mark.parametrize("block", [100_000, 3])
def test_ranges_in_one_pass(spark, monkeypatch, block):
    rng = random.Random(6)
    texts = [(i, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(60, None), (61, "aaaa"), (62, "Аба абаба")]
    variants = [(q, 0, "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))) for q in range(8) for _ in range(3)] + [(9, 0, ""), (9, 0, "аба"), (8, 0, "aa")]
    t = spark.createDataFrame(texts, "id long, text string")
    v = spark.createDataFrame(variants, "q int, token_no int, variant string")
    want = search.match_ranges(t.crossJoin(v.select("q").distinct()), v)
    monkeypatch.setattr(search, "BLOCK", block)
    got = search.match_ranges_once(t, v)
    cols = ["id", "q", "start", "stop"]
    assert all_rows(got.select(cols)) == all_rows(want.select(cols)) and got.count() > 100
    hits = spark.createDataFrame([(61, 8), (61, 8), (5, 0)], "id long, q int")
    kept = [r for r in all_rows(want.select(cols)) if r[:2] in ((61, 8), (5, 0))]
    assert all_rows(search.match_ranges_once(t, v, hits).select(cols)) == kept and kept


def test_keyed_watch_works_on_the_batch_and_not_on_the_history(spark):
    schema = "id long, h string, replaced_by long, merged_into long"
    src, path, cp = (work_dir(spark, x) for x in ("src", "out", "cp"))
    queries = spark.createDataFrame([(1, "red"), (2, "blue")], "q int, query string")
    for n in range(6):
        rows = [(100 * n + k, "red blue" if k % 2 else "red", None, None) for k in range(20)] + [(1, "red blue", None, None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        progress = eventtime.stream_watch_keyed(spark.readStream.schema(schema).parquet(src), queries, path, cp)
        state = [p["stateOperators"][0] for p in progress if p["numInputRows"]]
        assert sum(s["numRowsUpdated"] for s in state) == (30 if n else 30) and sum(p["numInputRows"] for p in progress) == (32 if n else 30)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{path}/reported").select("q", "id").collect())
    assert got == sorted({(1, 100 * n + k) for n in range(6) for k in range(20)} | {(2, 100 * n + k) for n in range(6) for k in range(1, 20, 2)})
