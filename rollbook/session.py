"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_STAGES: dict[str, list[str]] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "rollbook") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEM", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.executorEnv.PYTHONPATH", str(Path(__file__).resolve().parents[1]))
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a session in one process (``local[n]``, as tests use) without that setting gets a folder of its own under /tmp.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="rollbook-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten."""
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage, so a lost executor never changes which row got which number, and later reads of the
    stage still prune columns and push filters down. :func:`free_stage` deletes what was written, :func:`free_stages` all stages.
    """
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    _STAGES.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session has written, with all that is in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stage_path(stage: DataFrame) -> str:
    """Where :func:`staged` wrote this very frame."""
    return _PATHS[stage]


def stage_bytes(stage: DataFrame) -> int:
    """The size of what :func:`staged` wrote for this very frame."""
    return path_bytes(stage.sparkSession, _PATHS[stage])


def path_bytes(spark: SparkSession, path: str) -> int:
    """The size of a file, or of all files of a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def free_stage(stage: DataFrame) -> None:
    """Delete what :func:`staged` wrote for this very frame. Frames made from it can't be read any more."""
    path = _PATHS.pop(stage)
    _STAGES[stage.sparkSession.sparkContext.applicationId].remove(path)
    delete_path(stage.sparkSession, path)


def unsent(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input and is not to be sent to the driver and all tasks.

    Spark sizes a table by its compressed files and takes exploded rows for one each, so it would broadcast millions of rows as a few megabytes.
    """
    return df.hint("merge")


def free_stages(spark: SparkSession) -> int:
    """Delete the stages that this session has written so far, and tell how many. Frames made from them can't be read any more."""
    paths = _STAGES.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete_path(spark, path)
    return len(paths)


def settle(df: DataFrame, **cols: Column) -> DataFrame:
    """Add costly columns so that each is computed once per row.

    They pass through a generator of one element, which later filters are not pushed through; otherwise every
    filter on a derived column would repeat the whole derivation.
    """
    return df.select(*[F.col(c) for c in df.columns if c not in cols], F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
