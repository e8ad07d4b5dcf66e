"""Session settings and the shared scratch location.

The operators never create a session; callers (tests, bench, the driver)
pass one in.  ``tuned_session`` is a convenience for local runs: it sets the
adaptive-execution knobs the operators rely on (runtime broadcast of small
join sides, partition coalescing, skew-join splitting) and keeps the UI off.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# AQE does three jobs for us: (1) it converts a sort-merge join into a
# broadcast join only after measuring the materialised side at runtime,
# (2) it coalesces the many tiny post-aggregation partitions, and (3) it
# splits skewed join partitions.
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
}


# Settings for a large cluster (hundreds of TB in, ~1000 executors).  The
# first shuffle of every statistic carries partial aggregates (one row per
# plot and task), so shuffles are small next to the scan; the scan split size
# and AQE's target partition size matter most.  Start with many shuffle
# partitions and let AQE coalesce them to the advisory size.
CLUSTER_CONF = {
    **ADAPTIVE_CONF,
    "spark.sql.files.maxPartitionBytes": str(512 * 1024 * 1024),
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    # static broadcast only below 10 MB by the planner's estimate; larger sides
    # are broadcast only by AQE after measuring them (ADAPTIVE_CONF)
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.files.maxRecordsPerFile": "50000000",
}


def tuned_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "plotstats") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    )
    for k, v in ADAPTIVE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def cluster_session(app_name: str = "plotstats") -> SparkSession:
    """Session for a cluster job started by spark-submit: master and resources
    come from the launcher, ``CLUSTER_CONF`` sets the plan knobs.  The shared
    ``spark.checkpoint.dir`` must be configured; there is no local fallback."""
    builder = SparkSession.builder.appName(app_name)
    for k, v in CLUSTER_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


LOCAL_FALLBACK = "/tmp/plotstats-checkpoints"


def is_local(master: str) -> bool:
    """One machine, one process: ``local``, ``local[8]``, ``local[*, 2]``."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, from ``spark.checkpoint.dir`` or
    the context.  Where neither is set, a local master gets a folder of this
    machine; on a cluster executors would each write to their own disk, so there
    it is an error.  Spark refuses to change core settings at runtime, so the
    folder is set on the context, not in the session conf."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext
    path = context.getCheckpointDir()
    if path:
        return path
    if not is_local(context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    context.setCheckpointDir(LOCAL_FALLBACK)
    return LOCAL_FALLBACK


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path on whatever store it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _hadoop(spark, path)
    return fs.exists(target)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, sorted; none if there is no such folder."""
    fs, target = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder, which a file system does as a whole; the target must not exist."""
    fs, a = _hadoop(spark, source)
    _, b = _hadoop(spark, target)
    fs.mkdirs(b.getParent())
    if fs.exists(b) or not fs.rename(a, b):
        raise FileExistsError(f"cannot move {source} to {target}")


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, target = _hadoop(spark, path)
    fs.delete(target, True)


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``scratch_path``, on whatever file system it lies."""
    if not path.startswith(ensure_checkpoint_dir(spark).rstrip("/") + "/"):
        raise ValueError(f"{path} is not below the checkpoint folder")
    remove_folder(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
