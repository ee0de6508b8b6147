"""Structured Streaming jobs: each writes tables in the shared folder and can be replayed batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import any_date
from ..operators import changes, health, merge, watch
from ..operators.changes import around_nulls
from ..operators.position import first_by
from ..sources.buckets import BucketedList, merge_incremental
from ..sources.publish import pointers, publish_versioned, read_current


def run_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Work off everything that is there, batch by batch, and stop."""
    job = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table that batches write; empty before the first one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], schema)


def _write_batch(df: DataFrame, path: str, batch: int) -> None:
    """One directory per batch: a replay overwrites its own output and nothing else."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def _state(spark: SparkSession, path: str, batch: int, schema: str) -> DataFrame:
    """The state after the batch before: each batch writes the whole state anew, so only one directory is read."""
    return _read(spark, f"{path}/batch={batch - 1}", schema)


# --- snapshots --------------------------------------------------------------------------------------

def stream_merge(
    snapshots: DataFrame, root: str, base_schema, today: Column, compare: Sequence[str], checkpoint: str, landing: str, snapshot_id: str = "snapshot",
    job: str = "merge", guards: dict | None = None, buckets: BucketedList | None = None, **options
) -> None:
    """Land all rows that are there, then merge snapshot by snapshot, in the order of their ids, each as the next version.

    ``snapshot_id`` is a column: several snapshots may come in one batch, and one in several. Each batch only lands its rows. When the
    stream is worked off, every landed snapshot that was not published yet is merged and published under the tag of job and id, so a
    replay changes nothing and a root may hold any number of versions before. A snapshot that a guard stops leaves the published
    version as it was and fails the job; so do rows that come for a snapshot already merged, as they can't be merged any more. With
    ``buckets`` the list is kept there and not in versions of the whole: each snapshot writes only the buckets that it changes.
    """
    spark = snapshots.sparkSession
    schema = snapshots.schema

    def handle(batch: DataFrame, n: int) -> None:
        _write_batch(batch, landing, n)

    run_batches(snapshots, checkpoint, handle)
    rows = _read(spark, landing, schema)
    sizes = {r[0]: r[1] for r in rows.groupBy(snapshot_id).agg(F.count(F.lit(1))).collect()}  # one row per snapshot
    published = pointers(spark, root) if buckets is None else buckets.versions()
    done = {r["tag"].rpartition("/") for r in published.filter(F.startswith("tag", F.lit(f"{job}/"))).collect()}  # one row per version
    done = {tag: int(n) for tag, _, n in done}
    late = [k for k, n in sizes.items() if done.get(f"{job}/{k}", n) != n]
    if late:
        raise RuntimeError(f"rows came for snapshots that are merged already: {sorted(late)}")
    for k in sorted(k for k in sizes if f"{job}/{k}" not in done):
        snap = rows.filter(F.col(snapshot_id) == k).select([c for c in schema.names if c != snapshot_id])
        if buckets is not None:
            verdict = lambda counts: merge.merge_guards(counts, **(guards or {}))
            merge_incremental(buckets, snap, today, compare, tag=f"{job}/{k}/{sizes[k]}", judge=verdict, **options)
            continue
        base = read_current(spark, root, base_schema)
        merged = merge.snapshot_merge(base, snap, today, compare, **options)
        judge = lambda written: merge.merge_guards(merge.merge_counts(written), **(guards or {}))
        publish_versioned(merged, root, judge, tag=f"{job}/{k}/{sizes[k]}")


# --- once-only announcements -----------------------------------------------------------------------

SENT = "id long, sent_on date"


def stream_once(rows: DataFrame, path: str, since: Column, today: Column, checkpoint: str, order: Sequence[Column] = (), keep_days: int | None = None) -> None:
    """Announce every row once: not when it or its predecessor was sent, in an earlier batch or in this one.

    Of a repeated id in a batch the first by ``order`` counts (by all its columns, where none is given). A row whose predecessor is
    announced in the same batch is left out. The state, ids with the day they were last sent, is written anew by each batch;
    marks older than ``keep_days`` are dropped from it, none by default.
    """
    spark = rows.sparkSession

    def handle(batch: DataFrame, n: int) -> None:
        marks = _state(spark, f"{path}/sent", n, SENT)
        if keep_days is not None:
            marks = marks.filter(F.col("sent_on") >= F.date_sub(today, keep_days))
        once = first_by(batch, ["id"], [*order, *[F.col(c) for c in batch.columns if c != "id"]], [c for c in batch.columns if c != "id"])
        fresh = changes.select_fresh(once.select(batch.columns), marks.select("id"), since)
        own = fresh.select(F.col("id").alias("edit_of"))
        fresh = around_nulls(fresh, "edit_of", own, "left_anti")
        _write_batch(fresh, f"{path}/announced", n)
        sent = _read(spark, f"{path}/announced/batch={n}", batch.schema)
        new = sent.select(F.explode(F.array_compact(F.array("id", "edit_of"))).alias("id")).withColumn("sent_on", today)
        _write_batch(marks.unionByName(new).groupBy("id").agg(F.max("sent_on").alias("sent_on")), f"{path}/sent", n)

    run_batches(rows, checkpoint, handle)


# --- standing queries ------------------------------------------------------------------------------

def stream_watch(corpus: DataFrame, queries: DataFrame, path: str, checkpoint: str) -> None:
    """Report matches of each batch that no earlier batch reported."""
    spark = corpus.sparkSession
    id_type = dict(corpus.dtypes)["id"]

    def handle(batch: DataFrame, n: int) -> None:
        found = watch.watch_matches(batch, queries).select("q", "id").distinct()
        before = _read(spark, path, f"q int, id {id_type}, batch int").filter(F.col("batch") < n)
        _write_batch(found.join(before, ["q", "id"], "left_anti"), path, n)

    run_batches(corpus, checkpoint, handle)


# --- series counts ---------------------------------------------------------------------------------

def stream_buckets(events: DataFrame, stamp: str, series: str, path: str, checkpoint: str, width: str = "1 day") -> None:
    """Counts per window and series, each batch's own; :func:`final_buckets` sums them. Exact however late an event comes."""

    def handle(batch: DataFrame, n: int) -> None:
        counts = batch.groupBy(F.window(stamp, width).alias("w"), series).agg(F.count(F.lit(1)).alias("n"))
        _write_batch(counts.select(F.col("w.start").alias("start"), series, "n"), path, n)

    run_batches(events, checkpoint, handle)


def final_buckets(spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """The count of each window over all batches."""
    return _read(spark, path, f"{schema}, batch int").groupBy(*keys).agg(F.sum("n").alias("n"))


# --- inbox -----------------------------------------------------------------------------------------

def inbox_rows(files: DataFrame) -> DataFrame:
    """Raw lines of dropped files with the version each file stands for: a date in its name, else its file date."""
    name = F.col("_metadata.file_name")
    iso = F.try_to_date(F.regexp_extract(name, "(\\d{4}-\\d{2}-\\d{2})", 1), "yyyy-MM-dd")
    version = F.coalesce(iso, any_date(name), F.col("_metadata.file_modification_time").cast("date"))
    return files.select("value", name.alias("file_name"), F.col("_metadata.file_path").alias("file_path"), version.alias("version"))


def stream_inbox(files: DataFrame, parse: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Import dropped files. Of each id the last record of the latest file (by name) stays; a file with any line that
    does not parse goes to quarantine as a whole and leaves the list untouched.

    ``parse`` adds ``id`` (NULL for a bad line) and the payload to ``value, file_name, version``.
    """
    def handle(batch: DataFrame, n: int) -> None:
        rows = parse(batch)
        per_file = rows.groupBy("file_name").agg(F.count_if(F.col("id").isNull()).alias("bad"), F.count(F.lit(1)).alias("lines"))
        _write_batch(per_file.filter("bad > 0"), f"{path}/quarantine", n)
        good = rows.join(per_file.filter("bad > 0").select("file_name"), "file_name", "left_anti")
        _write_batch(good.drop("value"), f"{path}/records", n)

    run_batches(inbox_rows(files), checkpoint, handle)


def inbox_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The list after all imported files, in the order of their names and of ``line`` inside a file."""
    rows = _read(spark, f"{path}/records", f"{schema}, file_name string, version date, batch int")
    keep = [c for c in rows.columns if c != "id"]
    best = rows.groupBy("id").agg(F.max_by(F.struct(*keep), F.struct("file_name", "line")).alias("r"))
    return best.select("id", "r.*").drop("batch")


# --- source health ---------------------------------------------------------------------------------

HEALTH = "source long, checked_at timestamp_ntz, failing_since date, runs long"


def stream_health(runs: DataFrame, order: Sequence[Column], path: str, checkpoint: str) -> None:
    """Keep, per source, since when it has been failing. Batches come in time order.

    A batch is reduced to one row per source first: a good run in it starts the count anew from the failures
    after it, otherwise an outage that was known goes on. The state has one row per source and is written anew by each batch.
    """
    spark = runs.sparkSession

    def handle(batch: DataFrame, n: int) -> None:
        had_ok = batch.groupBy("source").agg(F.bool_or(~F.col("failed")).alias("had_ok"))
        now = health.failing_since(batch, order).join(had_ok, "source").alias("n")
        before = _state(spark, path, n, HEALTH).alias("b")
        quiet = F.col("n.source").isNull()
        going_on = F.when(quiet | ~F.col("n.had_ok"), F.col("b.failing_since"))
        state = now.join(before, F.col("n.source") == F.col("b.source"), "full_outer").select(
            F.coalesce("n.source", "b.source").alias("source"), F.coalesce("n.checked_at", "b.checked_at").alias("checked_at"),
            F.coalesce(going_on, F.col("n.failing_since")).alias("failing_since"),
            (F.coalesce("n.runs", F.lit(0)) + F.coalesce("b.runs", F.lit(0))).cast("long").alias("runs"),
        )
        _write_batch(state, path, n)

    run_batches(runs, checkpoint, handle)


def health_table(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each source."""
    return last_state(spark, path, HEALTH)


# --- newest day seen -------------------------------------------------------------------------------

def stream_high_water(rows: DataFrame, key: str, stamp: str, path: str, checkpoint: str) -> None:
    """The newest ``stamp`` of each ``key`` so far; the state has one row per key and is written anew by each batch."""
    spark = rows.sparkSession
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (key, stamp))

    def handle(batch: DataFrame, n: int) -> None:
        both = batch.select(key, stamp).unionByName(_state(spark, path, n, kinds))
        _write_batch(both.groupBy(key).agg(F.max(stamp).alias(stamp)), path, n)

    run_batches(rows, checkpoint, handle)


def last_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the last batch wrote."""
    rows = _read(spark, path, f"{schema}, batch int")
    last = rows.agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == (-1 if last is None else last)).drop("batch")
