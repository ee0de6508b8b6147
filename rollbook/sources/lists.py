"""Reading base lists, tagging and joining them, and choosing among sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.position import dense_position


def read_list(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", optional: bool = False) -> DataFrame:
    """A base list with its declared schema. An absent optional list is empty; an absent required one fails."""
    reader = spark.read.schema(schema).format(fmt)
    try:
        return reader.load(path)
    except AnalysisException as e:
        if optional and "PATH_NOT_FOUND" in (e.getCondition() or ""):
            return spark.createDataFrame([], schema)
        raise


def tagged_union(lists: Mapping[str, DataFrame]) -> DataFrame:
    """All lists in one table, each row tagged with its list; missing columns are NULL."""
    out = None
    for rank, (name, df) in enumerate(lists.items()):
        tagged = df.withColumn("list", F.lit(name)).withColumn("list_rank", F.lit(rank))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Snapshot parts one after the other, numbered from 1."""
    out = None
    for i, df in enumerate(parts, start=1):
        part = df.withColumn("part", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def best_source(records: DataFrame) -> DataFrame:
    """The candidate file to use: of the first source that has any, the one with most records, ties to the first.

    ``records`` has one row per parsed record with ``priority`` (of the source) and ``ord`` (of the file).
    """
    sizes = records.groupBy("priority", "ord").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.col("priority"), (-F.col("n")).alias("n"), F.col("ord"))
    return sizes.agg(F.min_by(F.struct("priority", "ord", "n"), rank).alias("best")).select("best.*")


def list_position(rows: DataFrame, order: Sequence[Column], by: str = "list") -> DataFrame:
    """1-based number of each row inside its own list."""
    return dense_position(rows, order, by=[by], name="n").withColumn("n", F.col("n") + 1)


def record_lookup(asked: DataFrame, details: DataFrame) -> DataFrame:
    """Details by id; an id without a record says so instead of showing another one."""
    found = details.withColumn("_found", F.lit(True))
    return asked.join(found, "id", "left").withColumn("stale", F.col("_found").isNull()).drop("_found")
