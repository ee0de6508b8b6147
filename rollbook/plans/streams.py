"""Streaming jobs run over the given tables to their end, with the final table as the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge
from ..operators.merge import HISTORY
from ..session import free_stage, stage_bytes, staged, work_dir
from ..sources.buckets import BucketedList
from ..sources.publish import publish_versioned, read_current
from ..streaming import eventtime, jobs
from .inputs import BASE_SQL, COMPARED, DOC_QUERIES, LATEST_SQL, SNAP_SQL, TODAY, base_list, day, docs, queries_of, snapshot, table
from .merging import MERGED_COLS, MERGED_SQL
from .news import RUNS_SQL, WATCH_SQL, _digest, _digest_sql, _runs
from .registry import query


#: Bytes of a stream's input, as it is compressed, for one file of a batch.
FILE_BYTES = 16_000_000


def _files_a_batch(stage, batches):
    """How many files each batch takes, so that a task writes and reads a bounded part of it."""
    return max(1, -(-stage_bytes(stage) // (batches * FILE_BYTES)))


def _write_in_turn(rows, part, parts, path, files):
    """The rows of each part as so many files, part after part: the files' times give the order in which a stream takes them."""
    for k in parts:
        own = rows.filter(F.col(part) == k).drop(part)
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.mode("append").parquet(path)


def _stream(df, label, order=None, files=3):
    """A frame written and read back as a file stream that comes in some batches (``files``), each of one file or, of more rows, of as many as
    it needs; in order, the oldest first."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    rows = staged(df, label)
    each = _files_a_batch(rows, files)
    if order is None:
        rows.repartition(files * each).write.parquet(path)
    else:
        placed = staged(rows.repartitionByRange(files * each, *order).withColumn("_file", F.floor(F.spark_partition_id() / each)), label)
        _write_in_turn(placed, "_file", range(files), path, each)
        free_stage(placed)
    free_stage(rows)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


def _stream_table(spark, sf, name):
    """A given table as a file stream; the pattern takes a single file as well as a directory."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


MERGED_OUT = (
    "id bigint, cust bigint, state string, price double, priority string, ord bigint, added date, is_removed boolean, removed date, edited date,"
    " edit_of bigint, replaced_by bigint, status string"
)


@query("stream_merge", f"WITH {MERGED_SQL} SELECT {', '.join(MERGED_COLS)} FROM merged")
def stream_merge(spark, sf):
    """One snapshot whose rows come in three batches."""
    root, checkpoint, landing = work_dir(spark, "stream-merge"), work_dir(spark, "checkpoint"), work_dir(spark, "landing")
    base = base_list(spark, sf)
    publish_versioned(base, root)
    schema = base.select("id", *COMPARED, *HISTORY).schema
    rows = _stream(snapshot(spark, sf).withColumn("snapshot", F.lit(1)), "snapshots")
    jobs.stream_merge(rows, root, schema, day(TODAY), COMPARED, checkpoint, landing, guards={"force": True}, initial=False)
    return read_current(spark, root, MERGED_OUT).select(*MERGED_COLS)


SEQUENCE_SQL = f"""{BASE_SQL}, {SNAP_SQL}, {LATEST_SQL},
first AS (SELECT id, cust, state, price, priority FROM latest),
second AS (SELECT id, cust, state, price + CASE WHEN cust % 3 = 0 THEN 5 ELSE 0 END AS price, priority FROM first WHERE abs(id) % 100 <> 7),
third AS (SELECT id, cust, state, price, priority FROM first WHERE abs(id) % 100 <> 8),
ids AS (SELECT id FROM base UNION SELECT id FROM latest),
steps AS (
  SELECT ids.id, b.id IS NOT NULL AS known, coalesce(b.is_removed, false) AS was_removed, f.id IS NOT NULL AS in1, s.id IS NOT NULL AS in2, t.id IS NOT NULL AS in3,
         b.price AS p0, f.price AS p1, s.price AS p2, t.price AS p3 FROM ids LEFT JOIN base b USING (id) LEFT JOIN first f USING (id) LEFT JOIN second s USING (id) LEFT JOIN third t USING (id))
SELECT id, coalesce(p3, p2, p1, p0) AS price, CASE WHEN in3 THEN false WHEN in2 OR in1 THEN true WHEN known THEN true ELSE true END AS is_removed,
  CASE WHEN in3 AND NOT in2 AND in1 AND p1 IS DISTINCT FROM p3 THEN 'returned_edited' WHEN in3 AND NOT in2 AND in1 THEN 'returned'
       WHEN in3 AND p2 IS DISTINCT FROM p3 THEN 'edited' WHEN in3 THEN 'kept' WHEN in2 THEN 'removed' ELSE 'kept' END AS status
FROM steps"""


def _sequence(spark, sf):
    """Three snapshots in one frame."""
    last = merge.keep_last(snapshot(spark, sf), "id", "src_pos")
    changed = F.col("price") + F.when(F.col("cust") % 3 == 0, 5).otherwise(0)
    parts = [
        last.withColumn("snapshot", F.lit(1)),
        last.filter(F.abs("id") % 100 != 7).withColumn("price", changed).withColumn("snapshot", F.lit(2)),
        last.filter(F.abs("id") % 100 != 8).withColumn("snapshot", F.lit(3)),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("stream_merge_sequence", f"WITH {SEQUENCE_SQL}")
def stream_merge_sequence(spark, sf):
    """Three snapshots in one folder, mixed over the batches, on a root that has versions already; and a replay of the whole."""
    root, landing = work_dir(spark, "stream-merge"), work_dir(spark, "landing")
    base = base_list(spark, sf)
    for _ in range(3):
        publish_versioned(base, root)
    rows = _sequence(spark, sf)
    schema = base.select("id", *COMPARED, *HISTORY).schema
    for checkpoint in (work_dir(spark, "checkpoint"), work_dir(spark, "checkpoint")):
        jobs.stream_merge(_stream(rows, "snapshots", files=2), root, schema, day(TODAY), COMPARED, checkpoint, landing, guards={"force": True, "min_removed": 10**9}, initial=False)
    return read_current(spark, root, MERGED_OUT).select("id", "price", "is_removed", "status")


@query("stream_once", f"WITH {_digest_sql('1995-01-01')} SELECT id, list, added FROM rows WHERE added >= DATE '1995-01-01'")
def stream_once(spark, sf):
    """Every order is announced exactly once, although half of the stream repeats it, in three batches."""
    rows, _ = _digest(spark, sf)
    rows = rows.withColumn("edit_of", F.lit(None).cast("bigint"))
    path = work_dir(spark, "announced")
    twice = rows.unionByName(rows.filter("list = 'm'"))
    jobs.stream_once(_stream(twice, "rows"), path, day("1995-01-01"), day(TODAY), work_dir(spark, "checkpoint"))
    return spark.read.parquet(f"{path}/announced").select("id", "list", "added")


@query("stream_watch", f"WITH {WATCH_SQL} SELECT q, id FROM matches")
def stream_watch(spark, sf):
    none = F.lit(None).cast("bigint")
    corpus = docs(spark, sf).select("id", "h", none.alias("replaced_by"), none.alias("merged_into"))
    path = work_dir(spark, "watched")
    jobs.stream_watch(_stream(corpus, "corpus"), queries_of(spark, DOC_QUERIES), path, work_dir(spark, "checkpoint"))
    return spark.read.parquet(path).select("q", "id")


@query("stream_watch_keyed", f"WITH {WATCH_SQL} SELECT q, id FROM matches")
def stream_watch_keyed(spark, sf):
    """The rows of ``stream_watch``, although a part of the documents comes twice, by state that is looked up by key."""
    none = F.lit(None).cast("bigint")
    corpus = docs(spark, sf).select("id", "h", none.alias("replaced_by"), none.alias("merged_into"))
    path = work_dir(spark, "watched")
    twice = corpus.unionByName(corpus.filter("id % 5 = 0"))
    eventtime.stream_watch_keyed(_stream(twice, "corpus"), queries_of(spark, DOC_QUERIES), path, work_dir(spark, "checkpoint"))
    return spark.read.parquet(f"{path}/reported").select("q", "id")


@query("stream_merge_buckets", f"WITH {SEQUENCE_SQL}")
def stream_merge_buckets(spark, sf):
    """The three snapshots of ``stream_merge_sequence`` on a list in buckets, and a replay; a snapshot writes only the buckets that it changes."""
    root, landing = work_dir(spark, "stream-merge"), work_dir(spark, "landing")
    base = base_list(spark, sf)
    schema = base.select("id", *COMPARED, *HISTORY).schema
    kept = BucketedList(spark, root, schema, buckets=8)
    kept.publish(base)
    for checkpoint in (work_dir(spark, "checkpoint"), work_dir(spark, "checkpoint")):
        jobs.stream_merge(
            _stream(_sequence(spark, sf), "snapshots", files=2), root, schema, day(TODAY), COMPARED, checkpoint, landing, guards={"force": True, "min_removed": 10**9}, initial=False, buckets=kept)
    rows = kept.read()
    before = kept.read(version=kept.version() - 1).select("id", F.col("price").alias("_price"), F.col("is_removed").alias("_removed"))
    both = rows.join(before, "id", "left")
    back, edited = F.col("_removed") & ~F.col("is_removed"), ~F.col("price").eqNullSafe(F.col("_price"))
    status = F.when(back & edited, "returned_edited").when(back, "returned").when(F.col("is_removed") & ~F.col("_removed"), "removed").when(edited, "edited").otherwise("kept")
    return both.select("id", "price", "is_removed", status.alias("status"))


def _wall_clock(col):
    """A stamp without a zone as an instant that shows the same wall clock in UTC."""
    part = lambda p: F.extract(F.lit(p), F.col(col))
    return F.make_timestamp(part("YEAR"), part("MONTH"), part("DAY"), part("HOUR"), part("MINUTE"), part("SECOND"), F.lit("UTC"))


def _buckets(spark, events):
    path = work_dir(spark, "windows")
    jobs.stream_buckets(events, "ts", "event_type", path, work_dir(spark, "checkpoint"))
    final = jobs.final_buckets(spark, path, "start timestamp, event_type string, n long", ["start", "event_type"])
    return final.withColumn("start", F.date_from_unix_date(F.floor(F.unix_seconds("start") / 86_400).cast("int")))


BUCKETS_SQL = "SELECT CAST(ts AS DATE) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"


@query("stream_buckets", BUCKETS_SQL)
def stream_buckets(spark, sf):
    """Windows follow the wall clock in any session zone."""
    return _buckets(spark, _stream_table(spark, sf, "events").withColumn("ts", _wall_clock("ts")))


@query("stream_buckets_late", BUCKETS_SQL)
def stream_buckets_late(spark, sf):
    """The newest days come in the first batch and the oldest in the last; nothing is late."""
    events = table(spark, sf, "events").select("event_type", _wall_clock("ts").alias("ts"))
    return _buckets(spark, _stream(events, "events", order=[F.desc("ts")]))


@query("stream_high_water", "SELECT user_id, max(CAST(ts AS DATE)) AS day FROM events GROUP BY 1")
def stream_high_water(spark, sf):
    """The newest day of each user, over batches of mixed days."""
    path = work_dir(spark, "high-water")
    rows = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"))
    jobs.stream_high_water(_stream(rows, "days"), "user_id", "day", path, work_dir(spark, "checkpoint"))
    return jobs.last_state(spark, path, "user_id bigint, day date")


@query("stream_health", f"""WITH {RUNS_SQL}, ok AS (SELECT source, max((ts, event_id)) FILTER (NOT failed) AS last_ok, max(ts) AS checked_at, count(*) AS runs FROM runs GROUP BY 1)
SELECT ok.source, runs, checked_at, (SELECT CAST(min(ts) AS DATE) FROM runs r WHERE r.source = ok.source AND failed AND (last_ok IS NULL OR (r.ts, r.event_id) > last_ok)) AS failing_since FROM ok""")
def stream_health(spark, sf):
    path = work_dir(spark, "health")
    runs = _stream(_runs(spark, sf), "runs", order=[F.asc("ts"), F.asc("event_id")])
    jobs.stream_health(runs, [F.col("ts"), F.col("event_id")], path, work_dir(spark, "checkpoint"))
    return jobs.health_table(spark, path).select("source", "runs", "checked_at", "failing_since")


@query("stream_inbox", """SELECT user_id AS id, max(event_type || ':' || lpad(CAST(event_id AS VARCHAR), 12, '0')) AS payload, CAST(max(CAST(ts AS DATE)) AS DATE) AS version FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC, event_id DESC) AS rn FROM events
  WHERE CAST(ts AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events WHERE value = (SELECT max(value) FROM events))) WHERE rn = 1 GROUP BY 1""")
def stream_inbox(spark, sf):
    """Events of a day as one dropped file named by the day; the day of the largest value has a bad line."""
    e = table(spark, sf, "events")
    top = e.agg(F.max("value")).scalar()
    key = F.when(F.col("value") == top, F.lit("broken")).otherwise(F.col("user_id").cast("string"))
    line = F.concat_ws("\t", key, F.lpad(F.col("event_id").cast("string"), 12, "0"), "event_type")
    inbox, path = work_dir(spark, "inbox"), work_dir(spark, "imported")
    e.select(F.to_date("ts").alias("day"), line.alias("value")).write.partitionBy("day").text(inbox)

    def parse(rows):
        part = F.split("value", "\t")
        day_of = F.to_date(F.regexp_extract(F.col("file_path"), "day=(\\d{4}-\\d{2}-\\d{2})", 1))
        rows = rows.withColumn("file_name", F.date_format(day_of, "yyyy-MM-dd")).withColumn("version", day_of)
        return rows.drop("file_path").withColumns({"id": F.get(part, F.lit(0)).try_cast("long"), "line": F.get(part, F.lit(1)), "kind": F.get(part, F.lit(2))})

    files = spark.readStream.format("text").option("maxFilesPerTrigger", 40).load(inbox + "/*")
    jobs.stream_inbox(files, parse, path, work_dir(spark, "checkpoint"))
    rows = jobs.inbox_list(spark, path, "id long, line string, kind string")
    return rows.select("id", F.concat_ws(":", "kind", "line").alias("payload"), "version")


# --- state by event time ----------------------------------------------------------------------------

LATE_SQL = "late AS (SELECT event_id FROM events, (SELECT min(ts) AS lo, max(ts) AS hi FROM events) WHERE event_id % 7 = 0 AND ts < lo + (hi - lo) / 4)"


@query("stream_buckets_watermark", f"""WITH {LATE_SQL}, edge AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM events),
windows AS (SELECT CAST(ts AS DATE) AS start, event_type, count(*) AS n FROM events WHERE event_id NOT IN (SELECT event_id FROM late) GROUP BY 1, 2)
SELECT CASE WHEN start + INTERVAL 1 DAY <= mark THEN 'closed' ELSE 'open' END AS state, start, event_type, n FROM windows, edge
UNION ALL SELECT 'late', NULL, event_type, count(*) FROM events WHERE event_id IN (SELECT event_id FROM late) GROUP BY event_type""")
def stream_buckets_watermark(spark, sf):
    """Days closed by a watermark of two days, those still open, and the events that came after their day was closed: a part of
    the oldest quarter of the time, which is delivered after everything else."""
    e = table(spark, sf, "events").select("event_id", "event_type", _wall_clock("ts").alias("ts"))
    lo, hi = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    is_late = (F.col("event_id") % 7 == 0) & (F.unix_micros("ts") < lo + (hi - lo) / 4)
    rank = F.when(is_late, F.lit(10)).otherwise(F.least(F.lit(3), F.floor((F.unix_micros("ts") - lo) * 4 / (hi - lo + 1))))
    path = work_dir(spark, "events")
    rows, parts = staged(e.withColumn("part", rank.cast("int")), "parts"), (0, 1, 2, 3, 10)
    each = _files_a_batch(rows, len(parts))
    _write_in_turn(rows, "part", parts, path, each)
    events = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", each).parquet(path)
    out, checkpoint = work_dir(spark, "closed"), work_dir(spark, "checkpoint")
    eventtime.stream_closed_buckets(events, "ts", "event_type", out, checkpoint)
    closed, still_open = eventtime.closed_buckets(spark, out, "event_type"), eventtime.open_buckets(spark, checkpoint, "event_type")
    late = eventtime.late_counts(spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), closed, still_open, "event_type")
    start = F.date_from_unix_date(F.floor(F.unix_seconds("start") / 86_400).cast("int")).alias("start")
    none = F.lit(None).cast("date").alias("start")
    parts = [closed.select(F.lit("closed").alias("state"), start, "event_type", "n"), still_open.select(F.lit("open").alias("state"), start, "event_type", "n"), late.select(F.lit("late").alias("state"), none, "event_type", "n")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("stream_once_watermark", f"WITH {_digest_sql('1995-01-01')} SELECT id, list, added FROM rows WHERE added >= DATE '1995-01-01'")
def stream_once_watermark(spark, sf):
    """The rows of ``stream_once``, by marks that Spark keeps for 60 days of event time and then gives up."""
    rows, _ = _digest(spark, sf)
    rows = rows.select("id", "list", "added", F.col("added").cast("timestamp").alias("stamp"))
    path = work_dir(spark, "announced")
    twice = _stream(rows.unionByName(rows.filter("list = 'm'")), "rows", order=[F.asc_nulls_last("added")], files=5)
    eventtime.stream_once_within(twice, ["id"], "stamp", path, work_dir(spark, "checkpoint"), since=F.lit("1995-01-01").cast("timestamp"))
    return spark.read.parquet(path).select("id", "list", "added")


@query("stream_source_state", f"""WITH {RUNS_SQL}, ok AS (SELECT source, max(ts) FILTER (NOT failed) AS last_ok, max(ts) AS checked_at, count(*) AS runs FROM runs GROUP BY 1),
since AS (SELECT ok.*, (SELECT min(ts) FROM runs r WHERE r.source = ok.source AND failed AND (last_ok IS NULL OR r.ts > last_ok)) AS failing_since FROM ok)
SELECT source, checked_at, failing_since, runs, failing_since IS NULL AND checked_at + INTERVAL 36 HOUR < (SELECT max(ts) FROM runs) - INTERVAL 2 DAY AS stale FROM since""")
def stream_source_state(spark, sf):
    """Sources whose runs come up to two days out of order: every third run is delivered with those of 40 hours later."""
    runs = _runs(spark, sf).select("source", _wall_clock("ts").alias("ts"), "failed", "event_id")
    arrives = F.unix_seconds("ts") + F.when(F.col("event_id") % 3 == 0, 40 * 3600).otherwise(0)
    stream = _stream(runs.withColumn("arrives", arrives), "runs", order=[F.asc("arrives"), F.asc("event_id")], files=4)
    path = work_dir(spark, "states")
    eventtime.stream_source_state(stream, path, work_dir(spark, "checkpoint"))
    utc = lambda c: F.to_utc_timestamp(F.from_utc_timestamp(c, F.current_timezone()), "UTC").cast("timestamp_ntz").alias(c)
    return eventtime.source_states(spark, path).select("source", utc("checked_at"), utc("failing_since"), "runs", "stale")
