"""Streaming jobs whose state is Spark's own, kept by event time and given up by watermark.

The jobs of :mod:`rollbook.streaming.jobs` are exact however late a row comes, and pay with tables that they read or write whole. Those here hold only
what rows within the watermark's delay can still change. State lives in RocksDB on the executors, with snapshots in the checkpoint. A
watermark is that of the batches before, so what it closes or drops takes effect one or two batches after the row that moved it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import watch
from .jobs import _read, _state, _write_batch, last_state, run_batches

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",  # a batch uploads what it changes, not all files of the state
}


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, so it is bounded by disk and not by an executor's heap."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _append(rows: DataFrame, path: str, checkpoint: str) -> list[dict]:
    """Append what a query gives out to a Parquet table, work off everything that is there and stop. The progress of the last batches."""
    with rocksdb(rows.sparkSession):
        job = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()
    return job.recentProgress


# --- tumbling windows ------------------------------------------------------------------------------

def stream_closed_buckets(events: DataFrame, stamp: str, series: str, path: str, checkpoint: str, width: str = "1 day", delay: str = "2 days") -> list[dict]:
    """Counts per window and series, each written once, when the watermark (the newest stamp less ``delay``) has passed the window's end.

    The state holds the open windows only. A row of a closed window is late and counts nowhere (:func:`late_counts`); rows without a
    stamp belong to no window. The table at ``path`` has ``start, end``, the series and ``n``. A replay writes nothing twice.
    """
    timed = events.select(stamp, series).filter(F.col(stamp).isNotNull()).withWatermark(stamp, delay)
    counts = timed.groupBy(F.window(stamp, width).alias("w"), series).agg(F.count(F.lit(1)).alias("n"))
    return _append(counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), series, "n"), path, checkpoint)


def closed_buckets(spark: SparkSession, path: str, series: str, series_type: str = "string") -> DataFrame:
    return _read(spark, path, f"start timestamp, end timestamp, {series} {series_type}, n long")


def open_buckets(spark: SparkSession, checkpoint: str, series: str) -> DataFrame:
    """The windows that are still open, with their counts so far, read from the state of the job."""
    with rocksdb(spark):
        state = spark.read.format("statestore").load(checkpoint)
    key = state.schema["key"].dataType.names
    return state.select(
        F.col(f"key.`{key[0]}`.start").alias("start"), F.col(f"key.`{key[0]}`.end").alias("end"), F.col(f"key.`{key[1]}`").alias(series), F.col("value.count").alias("n"))


def late_counts(delivered: DataFrame, closed: DataFrame, still_open: DataFrame, series: str) -> DataFrame:
    """Rows that came after their window was closed, per series: those delivered less those counted. ``delivered`` has the series and ``n``; none late: no row."""
    counted = closed.select(series, "n").unionByName(still_open.select(series, "n")).groupBy(series).agg(F.sum("n").alias("counted"))
    both = delivered.groupBy(series).agg(F.sum("n").alias("n")).alias("d").join(counted.alias("c"), F.col(f"d.{series}").eqNullSafe(F.col(f"c.{series}")), "left")
    return both.select(F.col(f"d.{series}").alias(series), (F.col("d.n") - F.coalesce("c.counted", F.lit(0))).alias("n")).filter("n > 0")


# --- once-only -------------------------------------------------------------------------------------

def stream_once_within(rows: DataFrame, key: Sequence[str], stamp: str, path: str, checkpoint: str, keep: str = "60 days", since: Column | None = None) -> list[dict]:
    """Pass on each key once: not again as long as its mark is kept, which is until the newest stamp is twice ``keep`` past the mark's.

    So of rows that come up to ``keep`` out of order no repeat within ``keep`` is passed on. A repeat after the mark is given up counts as new; a
    row more than ``keep`` behind the newest stamp is too old and left out, as are those before ``since`` and those without a stamp. To let an edited record pass for its predecessor, make both share a key column (the predecessor's id, else the own).
    Of rows with the same key in a batch any one is passed on. The state holds one mark for each key of that time.
    """
    timed = rows.filter(F.col(stamp).isNotNull()).withWatermark(stamp, keep)
    if since is not None:
        timed = timed.filter(F.col(stamp) >= since)
    return _append(timed.dropDuplicatesWithinWatermark(list(key)), path, checkpoint)


# --- standing queries ------------------------------------------------------------------------------

def stream_watch_keyed(corpus: DataFrame, queries: DataFrame, path: str, checkpoint: str) -> list[dict]:
    """Report matches of standing queries once, whatever was reported before, with work that follows the batch and not the history.

    Each batch lands its matches (``{path}/found``); a second query over them keeps the reported pairs of query and record as keys of its
    state, looks up only those of the batch and appends the new ones (``{path}/reported``). A replayed batch lands the same pairs, which are
    known by then. Records without an id match like any other, and pass once.
    """
    spark = corpus.sparkSession
    id_type, q_type = corpus.schema["id"].dataType.simpleString(), queries.schema["q"].dataType.simpleString()

    def handle(batch: DataFrame, n: int) -> None:
        _write_batch(watch.watch_matches(batch, queries).select("q", "id").distinct(), f"{path}/found", n)

    run_batches(corpus, f"{checkpoint}/found", handle)
    landed = spark.readStream.schema(f"q {q_type}, id {id_type}").parquet(f"{path}/found")
    return _append(landed.dropDuplicates(["q", "id"]), f"{path}/reported", f"{checkpoint}/reported")


# --- source health ---------------------------------------------------------------------------------

STALE_HOURS = 36  # fixed value: hours without a check after which a source that answers counts as stale
STATE = "checked_at timestamp, failed boolean, last_ok timestamp, first_failure timestamp, recent array<timestamp>, runs long"
OUT = "source long, checked_at timestamp, failing_since timestamp, runs long, stale boolean"


def _later(a: pd.Timestamp | None, b: pd.Timestamp | None) -> pd.Timestamp | None:
    return max((x for x in (a, b) if x is not None), default=None)


def _plain(x) -> pd.Timestamp | None:
    return None if x is None or pd.isna(x) else pd.Timestamp(x)


class SourceState:
    """What is known of one source: its last check, whether that failed, its last good run, and the failures after it.

    Of failures that no row can precede any more (those before the watermark) only the first is kept, and the others one by one, as a good
    run may still come in between. A failure and a good run of the same moment: the failure counts first, so the source is well.
    """

    def __init__(self, stored: tuple | None):
        checked, failed, ok, first, recent, runs = stored or (None, False, None, None, [], 0)
        self.checked, self.failed, self.ok, self.first, self.runs = _plain(checked), bool(failed), _plain(ok), _plain(first), int(runs)
        self.recent = [pd.Timestamp(x) for x in recent]

    def take(self, stamps: Sequence[pd.Timestamp], failed: Sequence[bool], watermark: pd.Timestamp) -> None:
        oks = [t for t, f in zip(stamps, failed, strict=True) if not f]
        failures = [t for t, f in zip(stamps, failed, strict=True) if f] + self.recent + [x for x in (self.first,) if x is not None]
        self.ok = _later(self.ok, max(oks, default=None))
        failures = sorted({t for t in failures if self.ok is None or t > self.ok})
        self.first = failures[0] if failures else None
        self.recent = [t for t in failures if t > watermark]
        self.checked = _later(self.checked, max(stamps, default=None))
        self.failed = self.first is not None
        self.runs += len(stamps)

    def stored(self) -> tuple:
        return self.checked, self.failed, self.ok, self.first, self.recent, self.runs


def source_updates(runs: DataFrame, delay: str = "2 days", stale_hours: int = STALE_HOURS) -> DataFrame:
    """``source, checked_at, failing_since, runs, stale`` of every source that had a run in a batch, or that has become stale.

    ``runs`` has ``source, ts, failed``; rows more than ``delay`` behind the newest run are left out. ``failing_since`` is the first failure after the
    last good run, in the order of time and not of arrival. A source that answers is stale when the watermark is more than ``stale_hours`` past
    its last check: an event-time timer of its state says so, even if no run of it ever comes again.
    """
    stale_ms = stale_hours * 3_600_000

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = SourceState(state.get if state.exists else None)
        watermark = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            rows = pd.concat(list(frames))
            known.take(rows["ts"].tolist(), rows["failed"].tolist(), pd.Timestamp(watermark, unit="ms"))
            state.update(known.stored())
        due = int(known.checked.value // 1_000_000) + stale_ms
        stale = due < watermark and not known.failed
        if due > watermark:
            state.setTimeoutTimestamp(due)
        yield pd.DataFrame({"source": [key[0]], "checked_at": [known.checked], "failing_since": pd.Series([known.first], dtype="datetime64[ns]"), "runs": [known.runs], "stale": [stale]})

    timed = runs.select("source", "ts", "failed").filter("source IS NOT NULL AND ts IS NOT NULL").withColumn("failed", F.coalesce("failed", F.lit(False))).withWatermark("ts", delay)
    return timed.groupBy("source").applyInPandasWithState(follow, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def stream_source_state(runs: DataFrame, path: str, checkpoint: str, delay: str = "2 days", stale_hours: int = STALE_HOURS) -> list[dict]:
    """Keep a table with one row for each source (see :func:`source_updates`); each batch writes it anew from the one before. Runs until all is worked off."""
    spark = runs.sparkSession

    def handle(batch: DataFrame, n: int) -> None:
        rows = _state(spark, path, n, OUT).withColumn("new", F.lit(0)).unionByName(batch.withColumn("new", F.lit(1)))
        _write_batch(rows.groupBy("source").agg(F.max_by(F.struct("checked_at", "failing_since", "runs", "stale"), "new").alias("s")).select("source", "s.*"), path, n)

    with rocksdb(spark):
        job = source_updates(runs, delay, stale_hours).writeStream.foreachBatch(handle).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()
    return job.recentProgress


def source_states(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each source."""
    return last_state(spark, path, OUT)
