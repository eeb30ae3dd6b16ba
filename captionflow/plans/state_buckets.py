"""Corpus state kept in buckets by the hash of the id, so that a listing reads and rewrites
the buckets it hits and leaves the others alone.

The state is a Parquet table partitioned by ``bucket``. An upsert takes the listing's
buckets (at most as many numbers as there are buckets), reads these partitions only, merges
as :func:`captionflow.operators.state.upsert_listing` does, and overwrites them. The merge
is written aside first, so a failed upsert leaves the state as it was or, if it fails while
partitions take their places, can be run again with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state as ST
from ..session import drop_staged, stage_table

BUCKETS = 1024


def bucket_of(video_id: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(video_id), F.lit(buckets)).cast("int")


def _write(state: DataFrame, path: str, buckets: int, mode: str) -> None:
    (state.withColumn("bucket", bucket_of("video_id", buckets)).repartition("bucket").sortWithinPartitions("bucket", "video_id")
     .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))


def write_buckets(state: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A state (one row for each id, with ``ord``) as a new table of buckets."""
    _write(ST.conform(state), path, buckets, "error")


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def upsert_buckets(spark: SparkSession, path: str, listing: DataFrame, playlist: str | None = None,
                   buckets: int = BUCKETS) -> DataFrame:
    """Upsert ``listing`` (state rows with ``ord`` of the state's type) into the table at
    ``path``, which has ``buckets`` buckets. Returns the rows of the buckets hit, staged,
    with ``src`` (state or listed) for :func:`~captionflow.operators.state.sync_counts`."""
    listed = stage_table(ST.conform(listing), "listed")
    hit = [r["b"] for r in listed.select(bucket_of("video_id", buckets).alias("b")).distinct().collect()]
    stored = spark.read.parquet(path).where(F.col("bucket").isin(hit)).drop("bucket")
    merged = ST.upsert_listing(stored, listed, playlist).withColumn("ord", F.col("ord.ord"))
    after = stage_table(merged, "upserted")
    if hit:
        _write(after.drop("src").select(*stored.columns), path, buckets, "overwrite")
    drop_staged(listed)
    return after
