"""Where runs keep their written tables.

Factor tables, stream state and other intermediate tables have to outlive any
one executor, so they go to the shared folder the cluster names in
``spark.checkpoint.dir``. Only a local-mode session may fall back to a folder
on this machine.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(
            "set spark.checkpoint.dir to a folder that every executor can reach"
        )
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        path = tempfile.mkdtemp(prefix="ridgeline-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _LOCAL_DIRS[app] = path
    return _LOCAL_DIRS[app]


def new_run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder (created by the first write)."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def write_table(df, path):
    """Write once, read back with the same schema: cuts lineage durably."""
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_dir(spark: SparkSession, path: str) -> None:
    """Remove a run folder through the file system that owns it."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop_path.getFileSystem(conf).delete(hadoop_path, True)


def list_versions(spark: SparkSession, path: str, key: str, marker: str = "_SUCCESS") -> list[int]:
    """Sub-folders ``key=<n>`` of ``path`` that hold the marker of a finished write."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/{key}=*/{marker}")
    found = pattern.getFileSystem(conf).globStatus(pattern) or []
    numbers = []
    for status in found:
        parent = status.getPath()
        while not parent.getName().startswith(f"{key}="):
            parent = parent.getParent()
        numbers.append(int(parent.getName().split("=")[1]))
    return sorted(numbers)
