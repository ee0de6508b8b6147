"""Statistics over dense calendar buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import rounded
from ..operators import stats
from .inputs import day, table
from .registry import query

EVENT_SERIES = ["click", "view", "purchase", "other"]
ORDER_SERIES = ["1-URGENT", "2-HIGH", "5-LOW", "other"]
NOW = "2001-06-15"

EVENTS_SQL = """daily AS (
  SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view,
         count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase')) AS other, count(*) AS total
  FROM events WHERE ts IS NOT NULL GROUP BY 1)"""
ORDERS_SQL = """daily AS (
  SELECT CAST(o_orderdate AS DATE) AS day, count(*) FILTER (o_orderpriority = '1-URGENT') AS n1, count(*) FILTER (o_orderpriority = '2-HIGH') AS n2,
         count(*) FILTER (o_orderpriority = '5-LOW') AS n5, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW')) AS other, count(*) AS total
  FROM orders WHERE o_orderdate IS NOT NULL AND o_orderstatus <> 'P' GROUP BY 1)"""
STEP = {"day": "1 DAY", "week": "7 DAY", "month": "1 MONTH", "quarter": "3 MONTH", "year": "1 YEAR"}


def events_daily(spark, sf):
    return stats.daily_counts(table(spark, sf, "events"), EVENT_SERIES, "ts", "event_type")


def orders_daily(spark, sf):
    """Undated where the state is 'P', to keep undated rows in the input."""
    rows = table(spark, sf, "orders").withColumn("o_orderdate", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    daily = stats.daily_counts(rows, ORDER_SERIES, "o_orderdate", "o_orderpriority")
    return daily.withColumnsRenamed({"1-URGENT": "n1", "2-HIGH": "n2", "5-LOW": "n5"})


ORDER_COLS = ["n1", "n2", "n5", "other"]


def bucket_sql(grain: str, until: str) -> str:
    sums = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in [*ORDER_COLS, "total"])
    return f"""{ORDERS_SQL}, cal AS (SELECT CAST(unnest(generate_series(date_trunc('{grain}', min(day)), date_trunc('{grain}', greatest(max(day), DATE '{until}')), INTERVAL {STEP[grain]})) AS DATE) AS start FROM daily),
bk AS (SELECT start, CAST(start + INTERVAL {STEP[grain]} AS DATE) AS stop, {sums} FROM cal LEFT JOIN daily ON date_trunc('{grain}', day) = start GROUP BY start)"""


def order_buckets(spark, sf, grain, until="2002-03-05"):
    return stats.buckets(orders_daily(spark, sf), grain, ORDER_COLS, day(until))


@query("daily_counts", f"WITH {EVENTS_SQL} SELECT * FROM daily")
def daily_counts(spark, sf):
    return events_daily(spark, sf)


def _bucket_query(grain):
    return lambda spark, sf: order_buckets(spark, sf, grain)


for _g in stats.GRAINS:
    query(f"buckets_{_g}", f"WITH {bucket_sql(_g, '2002-03-05')} SELECT * FROM bk")(_bucket_query(_g))


@query("bucket_range", f"WITH {bucket_sql('month', '2002-03-05')} SELECT * FROM bk WHERE stop > DATE '1999-05-10' AND start < DATE '2000-02-01'")
def bucket_range(spark, sf):
    return stats.visible_range(order_buckets(spark, sf, "month"), day("1999-05-10"), day("2000-02-01"))


def _trend_query(grain):
    half = stats.TREND_WINDOW[grain] // 2
    sql = f"""WITH {bucket_sql(grain, '2002-03-05')}
SELECT start, total, round(avg(n1 + n5 + other) OVER (ORDER BY start ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING), 6) AS trend FROM bk"""

    def run(spark, sf):
        rows = stats.trend(order_buckets(spark, sf, grain), stats.TREND_WINDOW[grain], ["n1", "n5", "other"])
        return rows.select("start", "total", F.round("trend", 6).alias("trend"))

    return sql, run


for _name, _g in (("bucket_trend", "day"), ("bucket_trend_month", "month")):
    _sql, _run = _trend_query(_g)
    query(_name, _sql)(_run)


@query("bucket_focus", f"""WITH {bucket_sql('quarter', '2002-03-05')},
n AS (SELECT *, lag(start) OVER (ORDER BY start) AS before, lead(start) OVER (ORDER BY start) AS after FROM bk)
SELECT start, stop, total, before, after FROM n ORDER BY (stop <= DATE '{NOW}') DESC, start DESC LIMIT 1""")
def bucket_focus(spark, sf):
    return stats.focus(order_buckets(spark, sf, "quarter"), day(NOW))


SUMMARY_SQL = f"""{ORDERS_SQL},
m AS (SELECT CAST(date_trunc('month', day) AS DATE) AS start, CAST(sum(total) AS BIGINT) AS total FROM daily GROUP BY 1),
s AS (SELECT CAST(sum(total) AS BIGINT) AS total,
  CAST(coalesce(sum(total) FILTER (day >= DATE '{NOW}' - 30 AND day < DATE '{NOW}' + 1), 0) AS BIGINT) AS last30,
  CAST(coalesce(sum(total) FILTER (day >= DATE '{NOW}' - 60 AND day < DATE '{NOW}' - 30), 0) AS BIGINT) AS prev30,
  CAST(coalesce(sum(total) FILTER (day >= DATE '{NOW}' - 365 AND day < DATE '{NOW}' + 1), 0) AS BIGINT) AS last365,
  CAST(coalesce(sum(total) FILTER (day >= DATE '{NOW}' - 730 AND day < DATE '{NOW}' - 365), 0) AS BIGINT) AS prev365, min(day) AS first_day,
  (SELECT start FROM m ORDER BY total DESC, start LIMIT 1) AS peak_start, (SELECT total FROM m ORDER BY total DESC, start LIMIT 1) AS peak_total FROM daily)"""


@query("period_summary", f"WITH {SUMMARY_SQL} SELECT * FROM s")
def period_summary(spark, sf):
    return stats.period_summary(orders_daily(spark, sf), day(NOW))


@query("period_delta", f"""WITH {SUMMARY_SQL} SELECT CAST(CASE WHEN prev30 <> 0 THEN floor((last30 - prev30) / prev30 * 100 + 0.5) END AS BIGINT) AS d30,
CAST(CASE WHEN prev365 <> 0 THEN floor((last365 - prev365) / prev365 * 100 + 0.5) END AS BIGINT) AS d365,
CAST(floor(last365 / total * 100 + 0.5) AS BIGINT) AS share365 FROM s""")
def period_delta(spark, sf):
    s = stats.period_summary(orders_daily(spark, sf), day(NOW))
    c = F.col
    return s.select(
        stats.change_percent(c("last30"), c("prev30")).alias("d30"), stats.change_percent(c("last365"), c("prev365")).alias("d365"),
        stats.share_percent(c("last365"), c("total")).alias("share365"),
    )


@query("year_stats", """SELECT year(o_orderdate) AS year, count(*) AS n, (SELECT floor(avg((o_orderpriority = '1-URGENT')::INT) * 1000 + 0.5) / 10 FROM orders) AS share FROM orders GROUP BY 1""")
def year_stats(spark, sf):
    years, share = stats.year_stats(table(spark, sf, "orders"), "o_orderdate", F.col("o_orderpriority") == "1-URGENT")
    return years.withColumn("share", share.scalar())


@query("top_years", "SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 6")
def top_years(spark, sf):
    from ..operators.changes import top_years as newest

    return newest(stats.year_stats(table(spark, sf, "orders"), "o_orderdate", F.lit(False))[0])


@query("percent_rounding", """SELECT day, CAST(floor((click - view) / total * 100 + 0.5) AS BIGINT) AS diff FROM (
  SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) AS total FROM events GROUP BY 1)""")
def percent_rounding(spark, sf):
    return events_daily(spark, sf).select("day", rounded((F.col("click") - F.col("view")) / F.col("total") * 100).alias("diff"))
