"""Streams by event time: what is closed, what is late, what is marked, what is stale, and how much state that takes."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rollbook.session import work_dir
from rollbook.streaming import eventtime, jobs

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 3, 1)


def stream(spark, batches, schema):
    """One file for each list of rows, taken one by one in this order."""
    path = work_dir(spark, "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), path


def most_rows(progress):
    return max(p["stateOperators"][0]["numRowsTotal"] for p in progress)


def test_windows_close_and_late_rows_are_told(spark):
    day = lambda n, h=1: START + n * DAY + dt.timedelta(hours=h)
    batches = [
        [(day(0), "a"), (day(0, 23), "a"), (day(1), None), (None, "a")],
        [(day(4), "a"), (day(1, 5), "b")],  # one day behind the newest: counts
        [(day(9), "b")],
        [(day(0, 2), "a"), (day(1, 2), "b"), (day(0, 3), "c"), (day(9, 2), "b")],  # days long closed
    ]
    events, path = stream(spark, batches, "ts timestamp, kind string")
    out, checkpoint = work_dir(spark, "out"), work_dir(spark, "cp")
    eventtime.stream_closed_buckets(events, "ts", "kind", out, checkpoint)
    closed, still_open = eventtime.closed_buckets(spark, out, "kind"), eventtime.open_buckets(spark, checkpoint, "kind")
    key = lambda r: (r[0], str(r[1]))
    rows = lambda df: sorted([(r["start"], r["kind"], r["n"]) for r in df.collect()], key=key)
    assert rows(closed) == [(START, "a", 2), (START + DAY, None, 1), (START + DAY, "b", 1), (START + 4 * DAY, "a", 1)]
    assert rows(still_open) == [(START + 9 * DAY, "b", 2)]
    delivered = spark.read.parquet(path).filter("ts IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, eventtime.late_counts(delivered, closed, still_open, "kind").collect())) == [("a", 1), ("b", 1), ("c", 1)]
    eventtime.stream_closed_buckets(events, "ts", "kind", out, checkpoint)  # nothing new has come
    assert closed.count() == 4


def test_state_of_windows_does_not_grow_with_the_stream(spark):
    batches = [[(START + n * DAY + dt.timedelta(minutes=7 * k), "abc"[k % 3]) for k in range(30)] for n in range(20)]
    events, _ = stream(spark, batches, "ts timestamp, kind string")
    progress = eventtime.stream_closed_buckets(events, "ts", "kind", out := work_dir(spark, "out"), work_dir(spark, "cp"))
    assert most_rows(progress) <= 5 * 3  # of 60 windows
    assert spark.read.parquet(out).agg(F.sum("n")).scalar() is not None and spark.read.parquet(out).count() == 17 * 3


def test_marks_are_given_up(spark):
    """Each id again the day after: passed on once. The marks are those of the last days, not of the whole stream."""
    batches = [[(n * 10 + k, START + n * DAY) for k in range(-10, 10)] for n in range(24)]
    rows, _ = stream(spark, batches, "id long, at timestamp")
    progress = eventtime.stream_once_within(rows, ["id"], "at", out := work_dir(spark, "out"), work_dir(spark, "cp"), keep="5 days")
    got = [r["id"] for r in spark.read.parquet(out).collect()]
    assert sorted(got) == list(range(-10, 240))
    assert most_rows(progress) <= 130  # twice five days and the two batches that it takes to give marks up
    exact, _ = stream(spark, [[(i, at, None) for i, at in b] for b in batches], "id long, added timestamp, edit_of long")
    jobs.stream_once(exact, path := work_dir(spark, "exact"), F.lit(START), F.current_date(), work_dir(spark, "cp"))
    assert sorted(r["id"] for r in spark.read.parquet(f"{path}/announced").collect()) == sorted(got)


def test_an_edit_passes_for_its_predecessor_and_old_rows_stay_out(spark):
    batches = [[(1, 1, START), (2, 2, START), (3, 3, None)], [(9, 1, START + DAY), (10, 10, START + 40 * DAY)], [(13, 13, START + 40 * DAY)], [(11, 11, START), (1, 1, START + 41 * DAY)], [(12, 12, START + 41 * DAY)]]
    rows, _ = stream(spark, batches, "id long, root long, at timestamp")
    eventtime.stream_once_within(rows, ["root"], "at", out := work_dir(spark, "out"), work_dir(spark, "cp"), keep="10 days", since=F.lit(START))
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 1, 2, 10, 12, 13]  # 1 again long after, and never 11


def test_the_state_of_a_source_is_bounded_and_in_order_of_time():
    rng = random.Random(3)
    state, seen = eventtime.SourceState(None), []
    hours = [pd.Timestamp(START) + pd.Timedelta(hours=h) for h in range(400)]
    order = sorted(range(400), key=lambda h: h + rng.random() * 40)  # up to 40 hours out of order
    for a in range(0, 400, 25):
        rows = [(hours[h], rng.random() < 0.9) for h in order[a : a + 25]]
        watermark = max([t for t, _ in seen], default=pd.Timestamp(0)) - pd.Timedelta(hours=48)
        seen += rows
        state.take([t for t, _ in rows], [f for _, f in rows], watermark)
        state = eventtime.SourceState(state.stored())
        ok = max((t for t, f in seen if not f), default=pd.Timestamp(0))
        assert state.first == min((t for t, f in seen if f and t > ok), default=None)
        assert len(state.recent) <= 25 + 48 + 40 and state.runs == len(seen) and state.checked == max(t for t, _ in seen)


def test_sources_fail_recover_and_grow_stale(spark):
    at = lambda h: START + dt.timedelta(hours=h)
    batches = [
        [(1, at(0), False), (2, at(0), True), (3, at(0), False), (4, at(1), False), (None, at(0), True), (5, None, True), (6, at(0), None), (7, at(0), None)],
        [(1, at(10), True), (1, at(12), True), (2, at(20), True), (4, at(30), True)],
        [(1, at(11), False), (4, at(29), False)],  # arrives late: the outage of 1 began after it
        [(1, at(13), True), (3, at(3), False), (4, at(120), False)],
        [(6, at(121), True)],
        [(3, at(4), True)],  # too late
    ]
    runs, _ = stream(spark, batches, "source long, ts timestamp, failed boolean")
    path = work_dir(spark, "states")
    eventtime.stream_source_state(runs, path, work_dir(spark, "cp"))
    got = {r["source"]: (r["checked_at"], r["failing_since"], r["runs"], r["stale"]) for r in eventtime.source_states(spark, path).collect()}
    assert got == {
        1: (at(13), at(12), 5, False), 2: (at(20), at(0), 2, False), 3: (at(3), None, 2, True), 4: (at(120), None, 4, False), 6: (at(121), at(121), 2, False), 7: (at(0), None, 1, True)}


@pytest.mark.parametrize("hours,stale", [(84, False), (85, True)])
def test_stale_after_36_hours_and_not_before(spark, hours, stale):
    """The watermark, 48 hours behind the newest run of any source, must be more than 36 hours past the last check."""
    runs, _ = stream(spark, [[(1, START, False)], [(2, START + dt.timedelta(hours=hours), False)]], "source long, ts timestamp, failed boolean")
    path = work_dir(spark, "states")
    eventtime.stream_source_state(runs, path, work_dir(spark, "cp"))
    assert {r["source"]: r["stale"] for r in eventtime.source_states(spark, path).collect()} == {1: stale, 2: False}
