"""Dense calendar statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rounded

GRAINS = ["day", "week", "month", "quarter", "year"]
TREND_WINDOW = {"day": 14, "week": 8, "month": 6, "quarter": 4, "year": 3}
STEP = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}


def floor_to(day: Column, grain: str) -> Column:
    return F.date_trunc(grain, day).cast("date")


def next_of(start: Column, grain: str) -> Column:
    return F.to_date(start + F.expr(STEP[grain]))


def daily_counts(rows: DataFrame, series: Sequence[str], date: str = "date", by: str = "series") -> DataFrame:
    """Rows per day and series; undated rows drop out, an unknown series counts as the last one."""
    name = F.when(F.col(by).isin(*series), F.col(by)).otherwise(F.lit(series[-1]))
    dated = rows.filter(F.col(date).isNotNull()).select(F.col(date).cast("date").alias("day"), name.alias("s"))
    return dated.groupBy("day").agg(*[F.count_if(F.col("s") == x).alias(x) for x in series], F.count(F.lit(1)).alias("total"))


def buckets(daily: DataFrame, grain: str, series: Sequence[str], until: Column | None = None) -> DataFrame:
    """Every bucket from the first day to ``until`` (or the last day), empty ones included."""
    ends = daily.agg(F.min("day").alias("a"), F.max("day").alias("z")).filter("a is not null")
    last = F.col("z") if until is None else F.greatest(F.col("z"), until)
    starts = F.sequence(floor_to(F.col("a"), grain), floor_to(last, grain), F.expr(STEP[grain]))
    calendar = ends.select(F.explode(starts).alias("start"))
    cols = [*series, "total"]
    sums = daily.groupBy(floor_to(F.col("day"), grain).alias("start")).agg(*[F.sum(c).alias(c) for c in cols])
    return calendar.join(sums, "start", "left").select(
        "start", next_of(F.col("start"), grain).alias("stop"), *[F.coalesce(c, F.lit(0)).alias(c) for c in cols]
    )


def trend(series_rows: DataFrame, window: int, shown: Sequence[str]) -> DataFrame:
    """Centred moving average of the shown series, with partial windows at both ends.

    Works on buckets, so the single window partition is as long as the calendar, not as the data.
    """
    half = window // 2
    total = sum((F.col(c) for c in shown), F.lit(0))
    around = Window.partitionBy(F.lit(1)).orderBy("start").rowsBetween(-half, half)
    return series_rows.withColumn("trend", F.avg(total).over(around))


def visible_range(series_rows: DataFrame, a: Column, b: Column) -> DataFrame:
    return series_rows.filter((F.col("stop") > a) & (F.col("start") < b))


def focus(series_rows: DataFrame, now: Column) -> DataFrame:
    """The last complete bucket (else the last one) with its neighbours."""
    order = Window.partitionBy(F.lit(1)).orderBy("start")
    rows = series_rows.withColumn("before", F.lag("start").over(order)).withColumn("after", F.lead("start").over(order))
    rank = F.struct((F.col("stop") <= now).alias("done"), F.col("start"))
    cols = ["start", "stop", "total", "before", "after"]
    return rows.agg(F.max_by(F.struct(*cols), rank).alias("f")).select("f.*")


def period_summary(daily: DataFrame, now: Column) -> DataFrame:
    """Total, the last 30 and 365 days with the periods before them, the earliest peak month, the first day."""
    def between(a, b):
        inside = F.col("day") < b if a is None else (F.col("day") >= a) & (F.col("day") < b)
        return F.coalesce(F.sum(F.when(inside, F.col("total"))), F.lit(0))

    tomorrow = F.date_add(now, 1)
    d30, d60, y1, y2 = (F.date_sub(now, n) for n in (30, 60, 365, 730))
    months = daily.groupBy(floor_to(F.col("day"), "month").alias("start")).agg(F.sum("total").alias("total"))
    best = months.agg(F.min_by(F.struct("start", "total"), F.struct((-F.col("total")).alias("t"), F.col("start"))).alias("p"))
    return daily.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        between(d30, tomorrow).alias("last30"), between(d60, d30).alias("prev30"),
        between(y1, tomorrow).alias("last365"), between(y2, y1).alias("prev365"), F.min("day").alias("first_day"),
    ).withColumns({"peak_start": best.select("p.start").scalar(), "peak_total": best.select("p.total").scalar()})


def change_percent(cur: Column, prev: Column) -> Column:
    """Change in whole percent; nothing to compare with gives NULL."""
    return F.when(prev != 0, rounded((cur - prev) / prev * 100))


def share_percent(n: Column, of: Column) -> Column:
    return F.when(of != 0, rounded(n / of * 100)).otherwise(F.lit(0))


def year_stats(rows: DataFrame, date: str, flag: Column) -> tuple[DataFrame, DataFrame]:
    """Rows per year, and the share of flagged rows in percent to one decimal."""
    years = rows.filter(F.col(date).isNotNull()).groupBy(F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.count_if(flag)
    share = F.when(F.count(F.lit(1)) > 0, rounded(hit / F.count(F.lit(1)) * 1000) / 10).otherwise(F.lit(0.0))
    return years, rows.agg(share.alias("share"))


def coverage_counts(rows: DataFrame) -> DataFrame:
    """Per list: live, live without a date, folded, and live stand-alone records without a date."""
    alive = F.col("removed").isNull() & F.col("replaced_by").isNull()
    alone = F.col("merged_into").isNull()
    return rows.groupBy("list").agg(
        F.count_if(alive).alias("live"), F.count_if(alive & F.col("date").isNull()).alias("undated"),
        F.count_if(alive & ~alone).alias("folded"), F.count_if(alive & alone & F.col("date").isNull()).alias("alone_undated"),
    )
