"""A base list in buckets by id, of which a merge writes only those that it changes.

Every bucket is a folder of some version's data; the pointer table says which folder holds which bucket since which version. A new version
adds folders for the buckets that it touches and, last, one pointer for each. Folders are never changed, so earlier versions stay whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import merge
from ..session import delete_path, free_stage, staged
from .publish import GuardError

BUCKETS = 64
POINTER = "version long, bucket int, path string, tag string"
_NONE = -1  # stands for "no bucket": it tells that a version is there although it may touch nothing


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(POINTER).parquet(f"{root}/buckets")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], POINTER)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class BucketedList:
    """The published versions of a bucketed list. The number of buckets is that of the first version."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str, key: str = "id", buckets: int = BUCKETS):
        self.spark, self.root, self.key = spark, root, key
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        first = _pointers(spark, root).filter(F.col("bucket") == _NONE).agg(F.min_by("path", "version")).first()[0]
        self.buckets = int(first) if first else buckets

    def version(self) -> int:
        return _pointers(self.spark, self.root).agg(F.max("version")).first()[0] or 0

    def versions(self) -> DataFrame:
        """One row for each published version: ``version, tag``."""
        return _pointers(self.spark, self.root).filter(F.col("bucket") == _NONE).select("version", "tag")

    def is_done(self, tag: str) -> bool:
        return not _pointers(self.spark, self.root).filter(F.col("tag") == tag).isEmpty()

    def paths(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has rows, as of a version; one entry for each bucket."""
        rows = _pointers(self.spark, self.root).filter(F.col("bucket") != _NONE)
        if version is not None:
            rows = rows.filter(F.col("version") <= version)
        return {r["bucket"]: r["path"] for r in rows.groupBy("bucket").agg(F.max_by("path", "version").alias("path")).collect()}

    def read(self, version: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """The list as of a version, or some buckets of it."""
        paths = [p for b, p in sorted(self.paths(version).items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        # buckets are dealt out by size: one of many rows to several tasks, each of which adds a file to its folder
        path = f"{self.root}/data-{uuid.uuid4().hex}"
        placed = rows.select(self.schema.names).withColumn("_bucket", bucket_of(self.key, self.buckets))
        placed.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(path)
        return path, [r[0] for r in self.spark.read.parquet(path).select("_bucket").distinct().collect()] if not rows.isEmpty() else []

    def _point(self, path: str, filled: Sequence[int], emptied: Sequence[int], tag: str | None) -> None:
        now = self.version() + 1
        rows = [(now, _NONE, str(self.buckets), tag), *((now, b, f"{path}/_bucket={b}", tag) for b in filled), *((now, b, f"{path}/none", tag) for b in emptied)]
        for b in emptied:
            self.spark.createDataFrame([], self.schema).write.parquet(f"{path}/none", mode="ignore")
        self.spark.createDataFrame(rows, POINTER).coalesce(1).write.mode("append").parquet(f"{self.root}/buckets")

    def publish(self, rows: DataFrame, tag: str | None = None) -> None:
        """All rows anew, as the next version."""
        if tag is not None and self.is_done(tag):
            return
        before = set(self.paths())
        path, filled = self._write(rows)
        self._point(path, filled, sorted(before - set(filled)), tag)

    def change(self, changed: DataFrame, tag: str | None = None) -> list[int]:
        """Put rows in place of those of the same ids, or beside them if the ids are new, as the next version. Only their buckets are read and
        written; these are returned. Under a tag that is there already nothing happens."""
        if tag is not None and self.is_done(tag):
            return []
        changed = changed.select(self.schema.names)
        touched = sorted(r[0] for r in changed.select(bucket_of(self.key, self.buckets)).distinct().collect())
        path, filled = "", []
        if touched:
            rest = self.read(only=touched).join(changed.select(self.key), self.key, "left_anti").select(self.schema.names)
            path, filled = self._write(rest.unionByName(changed))
        self._point(path, filled, [], tag)
        return touched

    def forget_before(self, version: int) -> int:
        """Delete folders that no version from this one on needs; returns how many. Earlier versions can't be read any more."""
        rows = _pointers(self.spark, self.root).filter(F.col("bucket") != _NONE)
        versions = [r[0] for r in rows.filter(F.col("version") >= version).select("version").distinct().collect()]
        needed = set().union(*(self.paths(v).values() for v in {version, *versions}))
        gone = [r["path"] for r in rows.select("path").distinct().collect() if r["path"] not in needed]
        for path in gone:
            delete_path(self.spark, path)
        return len(gone)


def merge_incremental(
    base: BucketedList, snap: DataFrame, today: Column, compare: Sequence[str] | None = None, tag: str | None = None,
    judge: Callable[[DataFrame], DataFrame] | None = None, **options,
) -> tuple[DataFrame, list[int]]:
    """Merge a snapshot as :func:`rollbook.operators.merge.snapshot_merge` does, and publish it by writing only buckets of records that it changes.

    Returns the records that are not as they were, with their ``status`` and ``base_ord``, and the touched buckets. A record that is only at another
    place has status 'kept' there; all others of the list are kept as well. ``judge`` turns the counts of the merge into one row with a
    ``verdict``; any other than 'ok' leaves the published version as it was.
    """
    before = base.read()
    merged = merge.snapshot_merge(before, snap, today, compare, base_ord=True, **options)
    changed = staged(merged.filter((F.col("status") != "kept") | ~F.col("ord").eqNullSafe(F.col("base_ord"))), "changed")
    if judge is not None:
        known = F.lit(before.count()).cast("long")
        word = judge(merge.merge_counts(changed).withColumn("base_rows", known)).select("verdict").first()[0]
        if word != "ok":
            free_stage(changed)
            raise GuardError(word)
    return changed, base.change(changed, tag)
