"""Session settings the operators rely on, and the shared folder for written tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings: safe to apply to a session somebody else built.
RUNTIME_CONF = {
    # NTZ columns are UTC wall clock; casts between NTZ and LTZ must not shift them.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # bounds what a Python worker holds of long texts at once
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    # row_number() <= k is cut to k rows per group before the shuffle
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
    # sessions are merged before the shuffle, so a busy key does not send its rows
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}
# No Python call site per column expression: building a large plan takes half the time.
BUILD_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    for key, value in BUILD_CONF.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def local_session(name: str = "opsmetrics", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(map=BUILD_CONF)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


@lru_cache(maxsize=1)
def _local_root() -> str:
    root = tempfile.mkdtemp(prefix="opsmetrics-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def _application_root(spark: SparkSession) -> str:
    """This application's folder below the cluster's shared one (`spark.checkpoint.dir`).

    Only a session whose tasks run inside the driver process may do without: anywhere else a
    local folder would be a different one on every machine, and reads would miss files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/opsmetrics/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the application's shared folder."""
    return f"{_application_root(spark)}/{label}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clean_up(spark: SparkSession) -> None:
    """Delete everything this application has written with `stage` and `work_path`. Results that
    still read it cannot be computed any more."""
    delete_path(spark, _application_root(spark))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a written table in the shared folder.

    For a narrow intermediate result that several later steps read: they start from files that
    outlive any executor, and their plans stay small.
    """
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="opsmetrics-zip-")) / root.name
        spark.sparkContext.addPyFile(
            shutil.make_archive(str(target), "zip", root_dir=root.parent, base_dir=root.name))
        _SHIPPED.add(app)
