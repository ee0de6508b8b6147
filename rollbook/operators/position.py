"""Dense positions and ordered neighbours without pulling a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged


def dense_position(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """Add a 0-based position by ``order`` inside each ``by`` group (or overall).

    Rows are range-partitioned by group and order, so a group of any size spreads over many tasks; only the
    row counts per (partition, group) are summed up. ``order`` must be a total order for a repeatable result.
    """
    keys = [F.col(c) for c in by]
    rows = staged(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumns({"_mid": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}),
        "positions",
    )
    sizes = rows.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_start"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    s = starts.select(F.col("_part").alias("_s_part"), "_start", "_before", *[F.col(c).alias(f"_s_{c}") for c in by])
    same = F.col("_part") == F.col("_s_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    return rows.join(s, same).select(*df.columns, (F.col("_before") + F.col("_mid") - F.col("_start")).alias(name))


def with_previous(df: DataFrame, cols: Sequence[str], order: Sequence[Column], by: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Add the previous row's ``cols`` in each group, found by an equi-join on neighbouring positions."""
    placed = dense_position(df, order, by, name="_pos")
    before = placed.select(
        *[F.col(c).alias(f"_k_{c}") for c in by], (F.col("_pos") + 1).alias("_k_pos"), *[F.col(c).alias(prefix + c) for c in cols]
    )
    match = F.col("_pos") == F.col("_k_pos")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return placed.join(before, match, "left").select(*df.columns, "_pos", *[prefix + c for c in cols])


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``; map-side combined, so hot keys cost nothing extra."""
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*keep), rank).alias("_row"))
    return best.select(*keys, "_row.*")


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``."""
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*keep), rank).alias("_row"))
    return best.select(*keys, "_row.*")


def keep_last(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Of rows with the same key the last one stays, at its own position."""
    return last_by(df, [key], [F.col(pos)], [c for c in df.columns if c != key]).select(*df.columns)


def dict_encode(df: DataFrame, column: str, pos: str, code: str) -> tuple[DataFrame, DataFrame]:
    """Number the distinct values by first appearance; returns the encoded rows and the dictionary."""
    firsts = df.groupBy(column).agg(F.min(pos).alias("_first"))
    words = dense_position(firsts, [F.col("_first")], name=code).select(column, code)
    known = words.filter(F.col(column).isNotNull())
    null_code = words.filter(F.col(column).isNull()).select(code).scalar()
    coded = df.join(known, column, "left")
    return coded.withColumn(code, F.coalesce(F.col(code), null_code)).select(*df.columns, code), words
