"""Stop rules and metrics over a parsed snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dup_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows, distinct ids and the surplus; ids are grouped first so no task holds them all."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("ids"), (F.sum("n") - F.count(F.lit(1))).alias("dup_ids"))


def part_counts(df: DataFrame, part: str = "part") -> DataFrame:
    return df.groupBy(F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("n"))


def part_guards(counts: DataFrame, previous: DataFrame, min_part: int = 50, min_total: int = 1000, shrink: float = 0.02, force: bool = False) -> DataFrame:
    """First problem of a source that comes in numbered parts, or none.

    In order: a part other than the last is too small; the total is too small; there are fewer parts than before;
    a part lost more than max(5, 2 %). ``force`` waives the last two. Both inputs hold one row per part.
    """
    both = counts.join(previous.withColumnRenamed("n", "prev"), "part", "full_outer")
    totals = both.agg(
        F.sum("n").alias("total"), F.max(F.when(F.col("n").isNotNull(), F.col("part"))).alias("last_part"),
        F.count("n").alias("parts"), F.count("prev").alias("prev_parts"),
    )
    last = totals.select("last_part").scalar()
    lost = F.col("prev") - F.greatest(F.lit(5.0), F.col("prev") * shrink)
    per_part = both.select(
        "part",
        F.when((F.col("part") < last) & (F.col("n") < min_part), 1)
        .when(F.lit(not force) & (F.col("prev") > 0) & (F.col("n") < lost), 4).alias("rule"),
        F.col("n").alias("found"), F.col("prev").alias("expected"),
    )
    whole = totals.select(
        F.lit(None).cast("int").alias("part"),
        F.when(F.col("total") < min_total, 2).when(F.lit(not force) & (F.col("parts") < F.col("prev_parts")), 3).alias("rule"),
        F.when(F.col("total") < min_total, F.col("total")).otherwise(F.col("parts")).alias("found"),
        F.col("prev_parts").alias("expected"),
    )
    problems = per_part.unionByName(whole).filter("rule is not null")
    return problems.agg(
        F.min_by(F.struct("rule", "part", "found", "expected"), F.struct("rule", "part")).alias("p")
    ).select(
        F.coalesce("p.rule", F.lit(0)).alias("rule"),
        F.element_at(F.array(*[F.lit(x) for x in PART_PROBLEMS]), F.coalesce("p.rule", F.lit(0)) + 1).alias("problem"),
        "p.part", "p.found", "p.expected",
    )


PART_PROBLEMS = ["ok", "part_too_small", "total_too_small", "fewer_parts", "part_shrank"]


def snapshot_guards(metrics: DataFrame, min_rows: dict[str, int], max_skipped: float = 0.01) -> DataFrame:
    """Per source: too few rows, too many rejects, or ok. ``metrics`` has ``source, kept, skipped``."""
    floor = F.create_map(*[F.lit(x) for kv in min_rows.items() for x in kv])
    need = F.coalesce(F.try_element_at(floor, F.col("source")), F.lit(0))
    return metrics.withColumn(
        "verdict",
        F.when(F.col("kept") < need, "too_few").when(F.col("skipped") > (F.col("kept") + F.col("skipped")) * max_skipped, "too_many_rejects").otherwise("ok"),
    )


def ingest_metrics(parts: DataFrame, names: list[str]) -> DataFrame:
    """Reject counters of all parts added up."""
    return parts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
