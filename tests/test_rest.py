"""Positions, statistics, changes, health, publishing and privacy on small frames."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rollbook.functions import dates, text
from rollbook.operators import changes, guards, health, position, stats
from rollbook.session import work_dir
from rollbook.sources import ingest, lists, pages, publish
from rollbook.streaming import jobs

day = lambda s: F.lit(s).cast("date")


def test_dense_position_with_a_hot_group(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "b").when(F.col("id") < 5, "a").otherwise("hot").alias("g"))
    got = {r["id"]: (r["g"], r["pos"]) for r in position.dense_position(df, [F.desc("id")], by=["g"]).collect()}
    want = {}
    for g in ("a", "b", "hot"):
        for n, i in enumerate(sorted((i for i in range(3000) if got[i][0] == g), reverse=True)):
            want[i] = (g, n)
    assert got == want
    assert [r["pos"] for r in position.dense_position(df, [F.col("id")]).orderBy("id").collect()] == list(range(3000))


def test_dict_encode_numbers_by_first_appearance(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, None), (4, "c")], "pos long, v string")
    rows, words = position.dict_encode(df, "v", "pos", "code")
    assert {(r["pos"], r["code"]) for r in rows.collect()} == {(0, 0), (1, 1), (2, 0), (3, 2), (4, 3)}
    assert words.count() == 4


def test_previous_row_crosses_partitions(spark):
    df = spark.range(500).select(F.lit(1).alias("source"), F.col("id").alias("t"), (F.col("id") % 7 < 3).alias("failed"))
    got = sorted((r["t"], r["failed"]) for r in health.history_transitions(df, [F.col("t")]).collect())
    prev, want = False, []
    for t in range(500):
        if (t % 7 < 3) != prev:
            prev = not prev
            want.append((t, prev))
    assert got == want


def test_buckets_and_trend(spark):
    items = spark.createDataFrame([("2026-08-26", "kgs"), ("2026-08-26", "kgs"), ("2026-08-20", "gpk"), ("2026-07-03", "zzz"), (None, "gpk")], "date string, series string")
    daily = stats.daily_counts(items, ["gpk", "kgs", "none"])
    months = stats.buckets(daily, "month", ["gpk", "kgs", "none"], day("2026-10-05"))
    assert [r["total"] for r in months.orderBy("start").collect()] == [1, 3, 0, 0]
    assert [round(r["trend"], 6) for r in stats.trend(months, 3, ["gpk", "kgs", "none"]).orderBy("start").collect()] == [2, 1.333333, 1, 0]
    assert [round(r["trend"], 6) for r in stats.trend(months, 3, ["gpk", "none"]).orderBy("start").collect()] == [1, 0.666667, 0.333333, 0]
    s = stats.period_summary(daily, day("2026-09-01")).first()
    assert (s["total"], s["last30"], s["peak_start"]) == (4, 3, dt.date(2026, 8, 1))
    assert stats.buckets(daily.limit(0), "day", ["gpk", "kgs", "none"]).count() == 0


def test_rounding_and_change(spark):
    r = spark.range(1).select(text.rounded(F.lit(-2.5)).alias("a"), stats.change_percent(F.lit(1), F.lit(0)).alias("b"), stats.share_percent(F.lit(1), F.lit(0)).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (-2, None, 0)


def greedy(sizes, header, again, limit):
    out, n, used, count = [], 0, header, 0
    for s in sizes:
        if used + 2 + s > limit and count:
            n, used, count = n + 1, again + 2 + s, 1
        else:
            used, count = used + 2 + s, count + 1
        out.append(n)
    return out


@pytest.mark.parametrize("chunk", [64, 100, 100_000])
def test_digest_pack_equals_the_greedy_loop(spark, chunk):
    rnd = random.Random(chunk)
    data = {"long": [rnd.randint(1, 60) for _ in range(1500)], "short": [200, 5], "one": [7], "big": [500, 500, 1, 1, 500]}
    rows = [(d, i, s) for d, ss in data.items() for i, s in enumerate(ss)]
    packed = changes.digest_pack(spark.createDataFrame(rows, "digest string, pos long, size long"), 20, 9, 100, chunk=chunk)
    got = {(r["digest"], r["pos"]): r["message"] for r in packed.collect()}
    assert got == {(d, i): n for d, ss in data.items() for i, n in enumerate(greedy(ss, 20, 9, 100))}


def test_part_guards_report_the_first_problem(spark):
    def check(now, before, **kw):
        c = spark.createDataFrame([(i + 1, n) for i, n in enumerate(now)], "part int, n long")
        p = spark.createDataFrame([(i + 1, n) for i, n in enumerate(before)], "part int, n long")
        r = guards.part_guards(c, p, **kw).first()
        return r["problem"], r["part"]

    assert check([1000, 3], []) == ("ok", None)
    assert check([40, 3000], []) == ("part_too_small", 1)
    assert check([500, 400], []) == ("total_too_small", None)
    assert check([2000], [2000, 10]) == ("fewer_parts", None)
    assert check([1000, 980, 5], [1000, 1000, 5]) == ("ok", None)
    assert check([1000, 979, 5], [1000, 1000, 5]) == ("part_shrank", 2)
    assert check([1000, 979], [1000, 1000, 5], force=True) == ("ok", None)


def test_source_transitions_only_on_flips(spark):
    schema = "source string, error string, fallback boolean, died boolean"
    prev = spark.createDataFrame([("a", None, False, False), ("b", "x", True, False), ("c", "x", None, False)], schema).drop("died")
    cur = spark.createDataFrame([("a", "down", True, True), ("b", None, False, False), ("c", "y", False, True), ("d", None, None, True)], schema)
    got = {(r["source"], r["message"]) for r in health.source_transitions(prev, cur).collect()}
    assert got == {("a", "source_down"), ("a", "fallback_on"), ("b", "source_up"), ("b", "fallback_off"), ("d", "step_died")}


def test_public_projection_never_shows_other_columns(spark):
    df = spark.createDataFrame([("p", "1", "n", "secret"), ("m", "2", "k", "secret"), ("x", "3", "k", "secret")], "list string, id string, name string, address string")
    got = publish.public_projection(df, {"p": ["id", "name"], "m": ["id"]}).collect()
    assert {r["record"] for r in got} == {'{"id":"1","name":"n"}', '{"id":"2"}'}


def test_publish_is_all_or_nothing(spark):
    root = work_dir(spark, "pub")
    word = lambda v: lambda rows: rows.agg(F.lit(v).alias("verdict"))
    ok, bad = word("ok"), word("too_many_removed")
    publish.publish_versioned(spark.range(3), root, ok)
    with pytest.raises(publish.GuardError):
        publish.publish_versioned(spark.range(9), root, bad)
    assert publish.read_current(spark, root, "id long").count() == 3
    publish.publish_versioned(publish.read_current(spark, root, "id long").union(spark.range(2)), root, ok, tag="job/1")
    publish.publish_versioned(spark.range(50), root, ok, tag="job/1")  # a replay
    assert publish.current_version(spark, root)[0] == 2 and publish.read_current(spark, root, "id long").count() == 5


def test_no_label_is_shipped(spark):
    from rollbook.functions import labels

    cols = {c: F.lit(None).cast("string") for c in ("agency", "kind", "type", "region", "court", "decided_by")}
    cols |= {"articles": F.lit(None).cast("array<string>"), "marked": F.lit(True)}
    row = spark.range(1).select(*[labels.record_label(F.lit(k), cols).alias(k) for k in "tp"], labels.record_label(F.lit("t"), cols, "Listed").alias("named")).first()
    assert (row["t"], row["p"], row["named"]) == ("", "", "Listed")


def test_codes_match_beside_cyrillic_letters(spark):
    """Only ASCII letters and digits make a word here: the short names of codes are found beside Cyrillic letters too."""
    from rollbook.functions.labels import article

    rows = spark.createDataFrame([("статья 12 ГПК", "gpk"), ("статья 12 НГПКА", "gpk"), ("статья 12 xГПК", None), ("статья 12 КГС.", "kgs")], "s string, want string")
    assert all(r["got"]["code"] == r["want"] for r in rows.select("want", article(F.col("s")).alias("got")).collect())


def test_optional_list(spark):
    assert lists.read_list(spark, "/tmp/rollbook-none", "id long", optional=True).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        lists.read_list(spark, "/tmp/rollbook-none", "id long").count()


def test_text_and_dates(spark):
    r = spark.range(1).select(
        text.clean(F.lit("a \r\n\n\n\n b \n c ")).alias("clean"), text.title_case(F.lit("АННА-МАРИЯ о'нил (x)")).alias("title"),
        text.normalize(F.lit("İΣ«Ёi »")).alias("norm"), dates.any_date(F.lit("44460")).alias("serial"), dates.day_first_date(F.lit("31.02.2020")).alias("bad"),
        dates.two_of_three(F.lit("11.07.1990"), F.lit("11.06.1990")).alias("near"), dates.two_of_three(F.lit(""), F.lit("")).alias("none"),
        dates.worded_date(F.lit("от 20 Августа 2026 года")).alias("worded"), ingest.first_decision(F.lit("Решение МВД от 18.10.2021 № 1ЭК")).alias("decision"),
        text.cut_title(F.lit("слово " * 60)).alias("cut"),
    ).first()
    assert r["clean"] == "a\n\nb\nc" and r["title"] == "Анна-Мария О'Нил (X)" and r["norm"] == 'İσ"еі "'
    assert r["serial"] == dt.date(2021, 9, 21) and r["bad"] is None and r["near"] and not r["none"]
    assert r["worded"] == dt.date(2026, 8, 20) and r["decision"] == "18.10.2021 1ЭК" and len(r["cut"]) <= 220 and r["cut"].endswith("слово…")


def test_blank_flood_is_linear(spark):
    import time

    df = spark.createDataFrame([(1, " " * 300_000 + "\t" + "\n" * 300_000)], "id long, body string")
    start = time.time()
    assert ingest.anchor_segments(df, "id", "body").count() == 0
    assert time.time() - start < 20


def test_urls(spark):
    page = "https://x.org/a/b/page.html?q=1#top"
    cases = {"/r": "https://x.org/r", "c.doc": "https://x.org/a/b/c.doc", "../c": "https://x.org/a/c", "//y.by/z": "https://y.by/z",
             "http://z/": "http://z/", "?p=2": "https://x.org/a/b/page.html?p=2", "/ü b": "https://x.org/%C3%BC%20b"}
    df = spark.createDataFrame(list(cases.items()), "h string, want string")
    for r in df.select("h", "want", pages.absolute_url(F.col("h"), F.lit(page)).alias("got")).collect():
        assert r["got"] == r["want"], r


def test_stream_over_several_batches(spark):
    """Two batches: announcements stay once-only, an outage survives a batch without a good run."""
    src, out, out2 = work_dir(spark, "src"), work_dir(spark, "out"), work_dir(spark, "out2")
    schema = "id long, edit_of long, added date, source long, ts timestamp_ntz, event_id long, failed boolean"
    t = lambda d, h: dt.datetime(2026, 1, d, h)
    one = [(1, None, dt.date(2026, 1, 1), 1, t(1, 1), 1, False), (2, None, dt.date(2026, 1, 1), 1, t(2, 1), 2, True), (9, None, dt.date(2026, 1, 1), 2, t(2, 1), 3, True)]
    two = [(2, None, dt.date(2026, 1, 2), 1, t(3, 1), 4, True), (3, 1, dt.date(2026, 1, 2), 2, t(3, 1), 5, False), (4, None, dt.date(2026, 1, 2), 2, t(4, 1), 6, True)]
    cp, cp2 = work_dir(spark, "cp"), work_dir(spark, "cp")
    for rows in (one, two):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        jobs.stream_once(spark.readStream.schema(schema).parquet(src), out, day("2025-12-01"), day("2026-01-05"), cp)
        jobs.stream_health(spark.readStream.schema(schema).parquet(src), [F.col("ts"), F.col("event_id")], out2, cp2)
    assert sorted(r["id"] for r in spark.read.parquet(f"{out}/announced").collect()) == [1, 2, 4, 9]
    got = {r["source"]: (r["failing_since"], r["runs"]) for r in jobs.health_table(spark, out2).collect()}
    assert got == {1: (dt.date(2026, 1, 2), 3), 2: (dt.date(2026, 1, 4), 3)}


def test_once_only_within_a_batch(spark):
    """Of a repeated id the first counts; a row whose predecessor is announced with it is left out; marks may expire."""
    src, out, cp = (work_dir(spark, x) for x in ("src", "out", "cp"))
    schema = "id long, edit_of long, added date, note string"
    d = dt.date(2026, 1, 1)
    spark.createDataFrame([(1, None, d, "b"), (1, None, d, "a"), (2, 1, d, "x"), (3, None, None, "no day"), (None, None, d, "no id")], schema).coalesce(1).write.parquet(src)
    jobs.stream_once(spark.readStream.schema(schema).parquet(src), out, day("2025-12-01"), day("2026-01-05"), cp)
    got = {(r["id"], r["note"]) for r in spark.read.parquet(f"{out}/announced").collect()}
    assert got == {(1, "a"), (None, "no id")}


def test_stream_merge_keeps_snapshots_apart(spark):
    """A root with versions; a snapshot in two batches and two in one; a replay; rows that come too late."""
    root, landing, src = (work_dir(spark, x) for x in ("root", "landing", "src"))
    payload = "id long, name string"
    base = spark.createDataFrame([(i, f"n{i}") for i in range(10)], payload).selectExpr(
        "id", "name", "id AS ord", "CAST(NULL AS date) AS added", "false AS is_removed", "CAST(NULL AS date) AS removed", "CAST(NULL AS date) AS edited",
        "CAST(NULL AS long) AS edit_of", "CAST(NULL AS long) AS replaced_by")
    for _ in range(3):
        publish.publish_versioned(base, root)
    schema = "id long, name string, src_pos long, snapshot int"
    files = [[(i, f"m{i}", i, 1) for i in range(6)], [(i, f"m{i}", i, 1) for i in range(6, 12)] + [(i, f"m{i}", i, 2) for i in range(1, 6)], [(i, f"m{i}", i, 2) for i in range(6, 12)]]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda cp: jobs.stream_merge(
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), root, base.schema, day("2026-01-05"), ["name"], cp, landing, initial=False)
    cp = work_dir(spark, "cp")
    run(cp)
    for _ in range(2):
        now = {r["id"]: (r["name"], r["is_removed"]) for r in publish.read_current(spark, root, base.schema).collect()}
        assert now == {i: (f"m{i}", i == 0) for i in range(12)}
        assert publish.current_version(spark, root)[0] == 5
        run(work_dir(spark, "cp"))
    spark.createDataFrame([(99, "late", 1, 2)], schema).coalesce(1).write.mode("append").parquet(src)
    with pytest.raises(RuntimeError, match="already"):
        run(cp)


def test_long_ragged_documents_carry_no_copies(spark):
    """Thousands of records in a document: each segment has its own few cells, and all records come out."""
    cell = lambda i: [str(i), f"Имя{'абвг'[i % 4]} Фамилия", "Name", "Страна", "01.02.1990", "Вступивший в законную силу приговор суда района , статья 130", "05.06.2020", "адрес", "справка"]
    docs = [(1, "\t".join(c for i in range(3000) for c in cell(i) + ([""] if i % 3 else []))), (2, "\t".join(cell(7))), (3, "")]
    got = ingest.anchor_segments(spark.createDataFrame(docs, "doc long, body string"), "doc", "body")
    rows = got.filter("outcome = 'record'").collect()
    assert sorted(r["num"] for r in rows if r["doc"] == 1) == list(range(3000))
    assert {(r["address"], r["info"]) for r in rows} == {("адрес", "справка")}


def test_late_events_are_counted(spark):
    src, out, cp = (work_dir(spark, x) for x in ("src", "out", "cp"))
    for d in (10, 20, 21, 11, 10):
        spark.createDataFrame([(dt.datetime(2026, 1, d, 5), "a")], "ts timestamp, kind string").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(src)
    jobs.stream_buckets(stream, "ts", "kind", out, cp)
    got = {r["start"].day: r["n"] for r in jobs.final_buckets(spark, out, "start timestamp, kind string, n long", ["start", "kind"]).collect()}
    assert got == {10: 2, 11: 1, 20: 1, 21: 1}


def test_digest_keeps_rows_of_no_list(spark):
    df = spark.createDataFrame([(1, "m"), (2, None), (3, "f"), (4, "?")], "id long, list string").withColumns({"added": day("2026-01-01"), "ord": F.col("id")})
    assert {r["id"]: r["number"] for r in changes.digest_rows(df, ["m", "f"]).collect()} == {1: 1, 2: 2, 4: 3, 3: 4}


def test_one_key_with_half_of_the_rows(spark):
    """Rows without a predecessor are half of all; none is lost and none meets the sent ids."""
    rows = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, F.col("id") - 1).alias("edit_of"), day("2026-01-01").alias("added"))
    sent = spark.createDataFrame([(7,), (8,)], "id long")
    got = {r["id"] for r in changes.select_fresh(rows, sent, day("2025-01-01")).collect()}
    assert got == set(range(2000)) - {7, 8}


def test_stages_can_be_freed(spark):
    from rollbook import session

    session.free_stages(spark)
    df = session.staged(spark.range(5))
    path = df.inputFiles()[0].rpartition("/")[0]
    assert df.count() == 5 and session.free_stages(spark) == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    from rollbook import session

    class Fake:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_root(Fake)


def test_segment_metrics_cut_each_document_once(spark):
    rows = [(1, 0, "skipped", 5, 0, ""), (1, 1, "record", 2, 1, "x"), (1, 2, "record", 3, 0, ""), (2, 0, "unanchored", 4, 0, "")]
    segments = spark.createDataFrame(rows, "doc int, seg int, outcome string, dropped int, excluded int, included string")
    found = ingest.segment_metrics(segments, "doc")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, 1, 1, 0, 3, 1), (2, 0, 0, 0, 1, 0, 0)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
