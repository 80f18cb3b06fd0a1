"""Session construction and the shared working folder.

On a cluster the working folder must be shared storage, so it is read
from ``spark.checkpoint.dir``.  Only when that setting is absent (local
tests, the smoke driver) do we pick a folder of our own and record it in
the session so every later call agrees.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "gatecast") -> SparkSession:
    """Session for tests and the bench.  Cluster jobs pass their own conf."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


# Settings for a large cluster (~100 TB inputs).  Shuffle partitions start
# high and AQE coalesces them to ~256 MB each; skewed join partitions are
# split; scans read 512 MB splits; only explicitly size-checked sides are
# broadcast beyond Spark's own 64 MB runtime threshold.
SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
}


def apply_scale_defaults(spark: SparkSession) -> SparkSession:
    """Apply ``SCALE_DEFAULTS`` for every key the job's own conf does not set."""
    given = spark.sparkContext.getConf()
    for k, v in SCALE_DEFAULTS.items():
        if not given.contains(k):
            spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """Folder under the cluster's shared checkpoint location.

    Reads ``spark.checkpoint.dir`` from the session; sets one only when it
    is unset and the master is local (tests), and also points the
    SparkContext at it so MLlib's periodic checkpoints write there.  On a
    cluster an unset value is an error rather than a machine-local folder.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach "
                               "(HDFS, object store); a machine-local folder is unsafe on a cluster")
        base = tempfile.mkdtemp(prefix="gatecast-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return "/".join([base.rstrip("/"), *parts]) if parts else base


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unique path below the shared folder; the writer that uses it creates it."""
    return shared_dir(spark, f"{label}-{uuid.uuid4().hex[:12]}")


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a finished intermediate below the shared folder, on whatever file system it is."""
    if not path.startswith(shared_dir(spark)):
        raise ValueError(f"{path} is not below the shared folder")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df, label: str = "materialized"):
    """Write ``df`` once as parquet under the shared folder and read it back.

    For frames that several jobs read (fit-then-transform, aggregate-then-
    join-back): the lineage is cut on shared storage, so later jobs neither
    recompute it nor depend on executors that may be lost, and the re-read
    keeps columnar pruning and pushed filters.
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
