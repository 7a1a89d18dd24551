"""Incremental backup as a stream of files: each micro-batch is a snapshot, the chunk table is the state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lodestack.plans.repo import Repo


#: What the source of whole files yields, to the letter.
FILES = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("modificationTime", T.TimestampType(), False), T.StructField("length", T.LongType(), False), T.StructField("content", T.BinaryType(), True)])


def incoming_files(spark: SparkSession, root: str, max_files: int = 10_000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(root)


def follow(repo: Repo, files: DataFrame, checkpoint: str) -> StreamingQuery:
    """Backs up what has arrived and stops. A batch that is run again writes no chunk twice; its snapshot is named after it."""

    def batch(rows: DataFrame, number: int) -> None:
        name = f"BATCH_{number:012d}"
        if repo.manifests.where(f"snapshot = '{name}'").isEmpty():
            repo.backup(rows.select("path", "content"), name)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
