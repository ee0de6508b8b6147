"""Publishing: versioned tables, fixed-size chunks and allow-listed columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_words
from ..functions.text import normalize_compact
from ..operators.position import dense_position

CHUNK = 200
POINTER = "version long, path string, tag string"


class GuardError(RuntimeError):
    """A stop rule fired; the published version stays as it was."""


def pointers(spark: SparkSession, root: str) -> DataFrame:
    """Every published version: number, path and the tag it was published under; empty before the first."""
    try:
        return spark.read.schema(POINTER).parquet(f"{root}/pointer")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], POINTER)


def current_version(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Number and path of the published version; (0, None) before the first."""
    row = pointers(spark, root).agg(F.max(F.struct("version", "path")).alias("p")).select("p.*").first()
    return (row["version"], row["path"]) if row["version"] is not None else (0, None)


def published_path(spark: SparkSession, root: str, tag: str) -> str | None:
    """Path of what was published under a tag."""
    row = pointers(spark, root).filter(F.col("tag") == tag).select("path").first()
    return row["path"] if row else None


def read_current(spark: SparkSession, root: str, schema) -> DataFrame:
    _, path = current_version(spark, root)
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


def publish_versioned(
    df: DataFrame, root: str, verdict: Callable[[DataFrame], DataFrame] | None = None, tag: str | None = None, partition_by: Sequence[str] = ()
) -> str:
    """All or nothing: the data goes to a path of its own, the stop rules judge what was written, the pointer is added last.

    So the data is computed once, and what is judged is what is published. ``verdict`` turns the written rows into one row with the
    word ``verdict``; any other than 'ok' leaves the published version as it was. The version is always the current one and one
    more. A ``tag`` names the work (a job and its input): publishing under a tag that is there already, as a replay does, changes
    nothing and returns the path of the first time.
    """
    spark = df.sparkSession
    if tag is not None and (done := published_path(spark, root, tag)):
        return done
    path = f"{root}/data-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    if verdict is not None:
        word = verdict(spark.read.schema(df.schema).parquet(path)).select("verdict").first()[0]
        if word != "ok":
            raise GuardError(word)
    now, _ = current_version(spark, root)
    spark.createDataFrame([(now + 1, path, tag)], POINTER).write.mode("append").parquet(f"{root}/pointer")
    return path


def chunk_rows(df: DataFrame, order: Sequence[Column], size: int = CHUNK) -> DataFrame:
    """Add the position in publication order and the number of the chunk that holds it."""
    return dense_position(df, order).withColumn("chunk", F.floor(F.col("pos") / size))


# --- files by number or by id, of which a reader opens only those it needs ------------------------------

SHELF = "_shelf"
CHUNKS_A_SHELF = 500


def write_chunks(df: DataFrame, order: Sequence[Column], path: str, size: int = CHUNK, chunks: int = CHUNKS_A_SHELF) -> None:
    """Write rows in publication order with ``pos`` and ``chunk``; a folder holds ``chunks`` chunks, one after another, so a chunk is found by its number."""
    rows = chunk_rows(df, order, size).withColumn(SHELF, F.floor(F.col("chunk") / chunks))
    rows.repartitionByRange(SHELF, "pos").sortWithinPartitions(SHELF, "pos").write.partitionBy(SHELF).parquet(path)


def read_chunks(numbers: DataFrame, path: str, chunks: int = CHUNKS_A_SHELF) -> DataFrame:
    """The rows of the chunks asked for (``chunk``)."""
    asked = numbers.select("chunk").distinct().withColumn(SHELF, F.floor(F.col("chunk") / chunks))
    return _from_shelves(asked, numbers.sparkSession.read.parquet(path), ["chunk"])


def write_by_id(df: DataFrame, path: str, key: str = "id", shelves: int = 256) -> None:
    """Write rows so that those of an id are found by its hash: folders by hash, sorted by id inside."""
    rows = df.withColumn(SHELF, _id_shelf(key, shelves))
    rows.repartition(SHELF).sortWithinPartitions(SHELF, key).write.partitionBy(SHELF).parquet(path)


def _id_shelf(key: str, shelves: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shelves)).cast("int")


def lookup_by_id(asked: DataFrame, path: str, key: str = "id", shelves: int = 256) -> DataFrame:
    """As :func:`rollbook.sources.lists.record_lookup`, over what :func:`write_by_id` wrote: only folders that asked ids fall into are read."""
    ids = asked.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(SHELF, _id_shelf(key, shelves))
    found = _from_shelves(ids, asked.sparkSession.read.parquet(path), [key]).withColumn("_found", F.lit(True))
    return asked.join(found, key, "left").withColumn("stale", F.col("_found").isNull()).drop("_found")


def _from_shelves(asked: DataFrame, rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows that are asked for. If the asked keys are few enough to be sent to all tasks, Spark lists only their folders (dynamic partition
    pruning, for which the asked side needs a filter); if not, they fall into nearly all folders anyway."""
    return rows.join(asked.filter(F.col(SHELF) >= 0), [SHELF, *on]).select([c for c in rows.columns if c != SHELF])


def public_projection(rows: DataFrame, allowed: Mapping[str, Sequence[str]], key: str = "id") -> DataFrame:
    """One JSON record per row with the columns its list may show and no other; unknown lists show nothing."""
    out = F.lit(None).cast("string")
    for name, cols in allowed.items():
        out = F.when(F.col("list") == name, F.to_json(F.struct(*cols))).otherwise(out)
    return rows.filter(F.col("list").isin(*allowed)).select("list", key, out.alias("record"))


def haystack(names: Sequence[Column] | Column, label: Column, place: Column, date: Column) -> Column:
    """Search text of a record: its names, the label, the place and the date in words, one per line."""
    listed = names if isinstance(names, Column) else F.array(*names)
    shown = F.array_join(F.filter(listed, lambda n: n.isNotNull() & (n != "")), "\n")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.concat_ws(
        "\n", normalize_compact(shown), normalize_compact(empty(label)), normalize_compact(empty(place)), date_words(date)
    )
