"""State of the sources: transitions, outages, stamps and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .position import with_previous


def source_transitions(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Messages for sources whose error or fallback state flipped; a run that died without saying so is one too.

    Both frames have ``source, error, fallback``; ``cur`` also ``died``.
    """
    p, c = prev.alias("p"), cur.alias("c")
    rows = p.join(c, F.col("p.source") == F.col("c.source"), "full_outer")
    failed, was_failed = (F.coalesce(F.col(f"{a}.error"), F.lit("")) != "" for a in ("c", "p"))
    spare, was_spare = (F.coalesce(F.col(f"{a}.fallback"), F.lit(False)) for a in ("c", "p"))
    died = F.coalesce(F.col("c.died"), F.lit(False)) & ~failed
    said = F.array(
        F.when(failed & ~was_failed, "source_down"), F.when(~failed & was_failed, "source_up"),
        F.when(spare & ~was_spare, "fallback_on"), F.when(~spare & was_spare, "fallback_off"), F.when(died, "step_died"),
    )
    return rows.select(
        F.coalesce("c.source", "p.source").alias("source"), F.explode(F.array_compact(said)).alias("message"),
        F.when(failed, F.col("c.error")).alias("error"),
    )


def history_transitions(runs: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Runs of a source whose failure flag differs from the run before (the first run compares with 'ok')."""
    rows = with_previous(runs, ["failed"], order, by=["source"])
    return rows.filter(F.col("failed") != F.coalesce("prev_failed", F.lit(False))).drop("_pos")


def failing_since(runs: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Per source: the day the current run of failures began, or NULL when the last run was fine.

    ``runs`` has ``source, ts, failed``. Two aggregations: the last good run, then the first failure after it.
    """
    rank = F.struct(*order)
    last_ok = runs.groupBy("source").agg(
        F.max(F.when(~F.col("failed"), rank)).alias("last_ok"), F.max("ts").alias("checked_at"), F.count(F.lit(1)).alias("runs")
    )
    after = runs.join(last_ok.select("source", "last_ok"), "source").filter("failed").filter(F.col("last_ok").isNull() | (rank > F.col("last_ok")))
    began = after.groupBy("source").agg(F.min("ts").cast("date").alias("failing_since"), F.count(F.lit(1)).alias("failures"))
    return last_ok.join(began, "source", "left").select(
        "source", "runs", "checked_at", "failing_since", F.coalesce("failures", F.lit(0)).alias("failures")
    )


def stamp(meta: str = "") -> Column:
    return F.coalesce(F.col(f"{meta}checked_at"), F.col(f"{meta}checked").cast("timestamp"), F.col(f"{meta}updated").cast("timestamp"))


def latest_stamp(metas: DataFrame) -> DataFrame:
    """The freshest source check; on equal times the source listed first (``rank``)."""
    return metas.filter(stamp().isNotNull()).agg(
        F.max_by(F.struct("source", stamp().alias("stamp")), F.struct(stamp(), -F.col("rank"))).alias("l")
    ).select("l.*")


def down_dates(metas: DataFrame) -> DataFrame:
    """Since when a source does not answer, and the last try when that was another day."""
    since = F.coalesce("failing_since", "checked", "updated")
    tried = F.coalesce(F.col("checked"), F.col("checked_at").cast("date"))
    return metas.select("source", since.alias("since"), F.when(tried != since, tried).alias("tried"))


def source_facts(metas: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per known ``source`` with its total and dates; a source never imported has total 0."""
    return sources.select("source").join(metas, "source", "left").select(
        "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("checked", "updated").alias("checked"),
        F.coalesce("source_date", "checked", "updated").alias("source_date"),
    )


def run_meta(merged: DataFrame, previous: DataFrame, today: Column, now: Column, initial: bool = False) -> DataFrame:
    """The metadata row of a run; 'last added' survives runs that add nothing. ``previous`` has at most one row."""
    added = F.count_if(F.col("status") == "new")
    touched = F.count_if(F.col("status") != "kept")
    row = merged.agg(
        F.count_if(~F.col("is_removed")).alias("total"), F.count_if(F.col("is_removed")).alias("removed_total"),
        added.alias("added"), touched.alias("touched"),
    )
    past = {c: previous.select(c).scalar() for c in ("updated", "last_added", "last_added_count")}
    grew = F.col("added") > 0
    first = F.lit(initial)
    return row.select(
        "total", "removed_total",
        F.when((F.col("touched") > 0) | past["updated"].isNull(), today).otherwise(past["updated"]).alias("updated"),
        today.alias("checked"), now.alias("checked_at"),
        F.when(grew & ~first, today).otherwise(past["last_added"]).alias("last_added"),
        F.when(first, F.lit(0)).when(grew, F.col("added")).otherwise(F.coalesce(past["last_added_count"], F.lit(0))).alias("last_added_count"),
    )
