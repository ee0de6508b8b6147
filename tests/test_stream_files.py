"""File streams made of frames: some batches, each of as many files as its rows need; buckets written by several tasks."""

import glob

from pyspark.sql import functions as F

from rollbook.plans import streams
from rollbook.sources.buckets import BucketedList
from rollbook.streaming.jobs import run_batches


def batches_of(stream, tmp_path):
    seen = {}

    def handle(batch, n):
        seen[n] = [r[0] for r in batch.select("id").collect()]

    run_batches(stream, str(tmp_path / "checkpoint"), handle)
    return [seen[n] for n in sorted(seen)]


def test_a_batch_of_many_rows_has_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FILE_BYTES", 20_000, raising=False)
    rows = spark.range(20_000).withColumn("text", F.md5(F.col("id").cast("string")))
    for order in (None, [F.asc("id")]):
        stream = streams._stream(rows, "many", order=order)
        got = batches_of(stream, tmp_path / str(order is None))
        assert len(got) == 3 and sorted(i for b in got for i in b) == list(range(20_000))
        if order is not None:
            assert max(got[0]) < min(got[1]) and max(got[1]) < min(got[2])


def test_files_a_batch_follow_the_size(spark, monkeypatch):
    rows = streams.staged(spark.range(50_000).withColumn("text", F.md5(F.col("id").cast("string"))), "sized")
    size = streams.stage_bytes(rows)
    assert streams._files_a_batch(rows, 3) == 1
    monkeypatch.setattr(streams, "FILE_BYTES", size // 30)
    assert 10 <= streams._files_a_batch(rows, 3) <= 11


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        kept = BucketedList(spark, str(tmp_path), "id long, text string", buckets=1)
        kept.publish(spark.range(0, 20_000, 1, 8).withColumn("text", F.md5(F.col("id").cast("string"))))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert kept.read().count() == 20_000
    assert len(glob.glob(f"{tmp_path}/data-*/_bucket=0/*.parquet")) > 3
