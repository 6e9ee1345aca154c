"""Reading tables, cutting lineage and other session matters."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as a full address; a temporary one only on a local master that names none, as in tests. It is for the cluster to
    clear; spark.cleaner.referenceTracking.cleanCheckpoints does so for checkpoints that are no longer referred to."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="quaylight-")
            atexit.register(shutil.rmtree, named[7:], ignore_errors=True)
        # an address without a scheme is one of the default file system; Spark resolves it
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def send_file(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    """Has a file of bounded size written, and gives every machine one copy; the name by which sent_file() finds it.

    The driver serves it, also to executors that come later, so it needs no folder in common.
    """
    folder = tempfile.mkdtemp(prefix="quaylight-sent-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{uuid.uuid4().hex}-{name}"
    write(path)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def sent_file(name: str) -> str:
    """Where a sent file lies on this machine, for a task."""
    return SparkFiles.get(name)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder: computed once, its values fixed, and safe when an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """df, a plain scan of files, in as many partitions as there are cores if it has fewer files, for work that outweighs moving the rows."""
    cores = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
