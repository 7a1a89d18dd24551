"""What every operator may need from the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"


def shared(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the session names; where it names none, a local one on a single machine only."""
    folder = spark.conf.get(CHECKPOINT, None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT} to a folder that the driver and all executors share")
    return f"{(folder or 'file://' + tempfile.mkdtemp(prefix='lodestack-')).rstrip('/')}/lodestack/{name}-{uuid.uuid4().hex[:12]}"


def newest(spark: SparkSession, folder: str) -> int | None:
    """The largest number that names a folder in ``folder`` which was written whole; None if there is none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = store.listStatus(path) if store.exists(path) else []
    names = [f.getPath() for f in found if f.isDirectory() and f.getPath().getName().isdigit()]
    return max((int(p.getName()) for p in names if store.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), default=None)


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder that the session names; where it names none, one is set on a single machine only."""
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get(CHECKPOINT, None)
        if not folder and not context.master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT} to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="lodestack-"))
    return df.checkpoint()
