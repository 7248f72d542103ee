"""Session helpers: a local session for tests, and reliable checkpoints."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import warnings
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local[cpus] session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vecloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


_settled: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application in spark.checkpoint.dir, which all executors share.

    It is read from the session. Only where it is unset and the session is of
    one process (as in local tests), a temporary folder of this machine is
    taken; a cluster has to name one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + _local_dir()
    folder = f"{at.rstrip('/')}/vecloom-{spark.sparkContext.applicationId}"
    _settled[folder] = spark
    return folder


@lru_cache(maxsize=1)
def _local_dir() -> str:
    warnings.warn("spark.checkpoint.dir is unset: settled tables go to a temporary folder of this machine", stacklevel=3)
    at = tempfile.mkdtemp(prefix="vecloom-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at


def release() -> None:
    """Deletes what settle() wrote in this process; frames that read it can't be used any more. Done at exit, too."""
    while _settled:
        path, spark = _settled.popitem()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001, S110
            pass  # the JVM is gone


atexit.register(release)


def settle(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written once to the shared folder and read back.

    A written table survives the loss of executors, keeps its row statistics
    for the planner, and is computed once however often it is read. It is
    deleted by release().
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    _settled[folder] = spark
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
