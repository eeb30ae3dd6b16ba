"""Spark session settings shared by tests, the bench and the entry points."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that hold on a cluster as well as in local mode. Shuffle partition
# count is left to the caller; AQE coalesces small partitions at run time and
# splits skewed join partitions.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "captionflow", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one with our settings."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        # local runs: loopback only, so large results come back reliably
        b = b.config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1")
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback_root: str | None = None) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the operator sets it to shared storage; we only read it. When it
    is unset (tests, local runs) a fresh scratch folder is created and set.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if d:
        d = str(d)
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(d)
        return d
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = fallback_root or os.environ.get("CAPTIONFLOW_SCRATCH") or "/tmp"
    d = tempfile.mkdtemp(prefix="captionflow-ckpt-", dir=root)
    sc.setCheckpointDir(d)
    return d


def stage_table(df, name: str):
    """Write ``df`` as a parquet table under the checkpoint folder and read it back.

    Cuts lineage (a lost executor never recomputes the upstream plan) and turns a
    DataFrame that feeds several branches into one scan instead of several
    copies of its plan. Columnar and compressed, unlike an RDD checkpoint.
    """
    import uuid
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/stage-{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    out = spark.read.parquet(path)
    out._staged_path = path   # for cleanup by the owner of the stage
    return out


#: Bytes of input in a bucket of a staged table (a bucket is one task's work: tokens and
#: sorts take some hundred times that in memory), and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 4 << 20, 20_000


def input_bytes(df) -> int | None:
    """Bytes of the tables that a plan reads, as the planner knows them; none if it does not
    know one of them (as of a stream's batch). A table that is read several times counts once."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    tables = df.sparkSession.sparkContext._jvm.java.util.HashMap()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        tables.put(leaf.canonicalized(), str(leaf.stats().sizeInBytes()))
    sizes = [int(x) for x in tables.values()]
    return sum(sizes) if max(sizes, default=0) < 1 << 60 else None


def stage_buckets(df, size: int | None = None) -> int:
    """How many buckets to stage a table of this plan's size in (``size``: its bytes, if the
    caller knows them): at least the cluster's parallelism, and as many as the input needs
    for buckets of bounded size, so that no task grows with the input."""
    spark = df.sparkSession
    if size is None:
        size = input_bytes(df)
    if size is None:
        return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(1, spark.sparkContext.defaultParallelism, min(MOST_BUCKETS, -(-size // BUCKET_BYTES)))


def stage_clustered(df, name: str, buckets: int, *by: str):
    """Like :func:`stage_table`, in ``buckets`` buckets by the hash of ``by``: joins,
    aggregates and windows on keys that hold ``by`` read it back without a shuffle. Joins
    on more keys than ``by`` count on ``CLUSTERED_JOINS`` for that."""
    import uuid
    spark = df.sparkSession
    tag = uuid.uuid4().hex
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{name}-{tag}"
    table = f"stage_{name.replace('-', '_')}_{tag}"
    df.write.mode("error").format("parquet").option("compression", "zstd").bucketBy(buckets, *by).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._staged_path, out._staged_table = path, table
    return out


#: Hint for joins of staged tables: bucket by bucket. The planner judges a table by its
#: compressed files and would broadcast millions of short rows to every task.
BY_BUCKET = "shuffle_hash"
#: With this setting a join on (video, window) uses sides that are both dealt by video.
CLUSTERED_JOINS = ("spark.sql.requireAllClusterKeysForCoPartition", "false")


def drop_staged(df) -> None:
    """Delete a staged table, with its entry in the catalog if it has one."""
    spark = df.sparkSession
    if getattr(df, "_staged_table", None):
        spark.sql(f"DROP TABLE IF EXISTS {df._staged_table}")
    if getattr(df, "_staged_path", None):
        drop_table_path(spark, df._staged_path)


def drop_table_path(spark: SparkSession, path: str) -> None:
    """Delete a staged table folder (shared storage, through Hadoop's FileSystem)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
