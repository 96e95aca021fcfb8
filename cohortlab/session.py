"""Session construction and lineage helpers."""
from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.ansi.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # finished queries and stages the driver remembers (each keeps its plan)
    "spark.sql.ui.retainedExecutions": "20",
    "spark.ui.retainedJobs": "200",
    "spark.ui.retainedStages": "200",
    "spark.ui.retainedTasks": "5000",
    "spark.driver.memory": "4g",   # local mode: the driver JVM is the executor (overridable via ``extra``)
}


def get_spark(master: str = "local[*]", shuffle_partitions: int | None = None, app: str = "cohortlab",
              extra: dict | None = None) -> SparkSession:
    """Builder used by tests and bench; on a cluster pass the master/conf of the cluster."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:      # else the session's own setting
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only when it is unset (local tests) create one."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="cohortlab-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint dir (survives executor loss).

    A checkpoint keeps the partitioning it was written with; AQE may have coalesced a small upstream
    shuffle to one partition, which would make every later pass over a re-read frame a single task.
    ``partitions`` (e.g. :func:`reread_partitions`) spreads the rows round-robin once before writing.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if partitions:
        df = df.repartition(int(partitions))
    return df.checkpoint(eager=True)


def reread_partitions(spark: SparkSession) -> int:
    """Partition count for frames re-read by every iteration: the cluster's default parallelism."""
    return max(1, spark.sparkContext.defaultParallelism)


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives executor loss, and gives the optimizer
    the real size (a join may broadcast it behind Spark's own threshold)."""
    path = os.path.join(ensure_checkpoint_dir(df.sparkSession), "tables", f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_counting(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """:func:`saved`, with aggregates of the written rows observed in the same job."""
    seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
    out = saved(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), name)
    return out, seen.get


def drop_saved(df: DataFrame) -> None:
    """Delete the folder behind a frame made by :func:`saved` (through Hadoop, so any shared store works)."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def run_by_value(*modules: str) -> None:
    """Send functions of these modules to the executors by value: they need numpy and Arrow, not this package."""
    from pyspark import cloudpickle
    for m in modules:
        cloudpickle.register_pickle_by_value(sys.modules[m])
