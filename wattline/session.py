"""Session helpers: a tuned local session for tests/bench, and the shared
checkpoint folder read from the session configuration."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "wattline") -> SparkSession:
    """Build (or reuse) a session with the settings the library assumes.

    Session time zone is UTC so timestamp arithmetic is identical on every
    executor; AQE is on so shuffle partition counts and skewed joins are
    re-planned at runtime.  The Spark UI stays off.  A session on this machine
    alone gets four shuffle partitions a core unless told otherwise; on a cluster
    the deployment's ``spark.sql.shuffle.partitions`` stands.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    cores = re.fullmatch(r"local\[(\d+)\]", master or f"local[{cpus}]")
    if shuffle_partitions is None and cores:
        shuffle_partitions = 4 * int(cores[1])
    b = (SparkSession.builder
         .master(master or f"local[{cpus}]")
         .appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("WATTLINE_DRIVER_MEMORY", "16g")))
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare_session(spark)
    return spark


def prepare_session(spark: SparkSession) -> None:
    """Settings every query relies on; safe to call repeatedly.

    The folds work on arrays of a time chunk, so few rows make an Arrow batch, and few
    rows of a stored table a batch of its reader, which holds all of them at once.
    A task writes up to 16 partitions or buckets side by side instead of sorting its
    rows by them first.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "32")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "256")
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "16")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment must name it, since executors don't share
    their local disks; only a session on this machine alone gets a temporary
    folder of its own where the setting is missing.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="wattline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d
