"""The stored location index: which drive has a chunk, and the registry of drives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack import schemas
from lodestack.operators import index
from lodestack.session import newest


class LocationIndex:
    """Sorted runs, the delta since the last of them, and the drives, in one folder; one writer at a time.

    Run n takes in run n - 1 and delta n - 1; what is added afterwards goes to delta n. A reader takes the newest run that
    was written whole, so a compaction that dies changes nothing and can be called again. An empty folder is an empty index.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, number: int | None, schema: str) -> DataFrame:
        if number is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{number}")

    @property
    def generation(self) -> int:
        return newest(self.spark, f"{self.root}/run") or 0

    @property
    def run(self) -> DataFrame:
        return self._read("run", newest(self.spark, f"{self.root}/run"), schemas.INDEX)

    @property
    def delta(self) -> DataFrame:
        """Of the present generation: an older one is in the run already."""
        at = self.generation
        there = newest(self.spark, f"{self.root}/delta")
        return self._read("delta", at if there == at else None, schemas.INDEX)

    @property
    def drives(self) -> DataFrame:
        return self._read("drives", newest(self.spark, f"{self.root}/drives"), schemas.DRIVES)

    def register(self, drive_id: str, label: str) -> int:
        """The drive's ordinal: a new one, or that which it has; the label is renewed."""
        number = (newest(self.spark, f"{self.root}/drives") or 0) + 1
        index.register_drive(self.drives, drive_id, label).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/drives/{number}")
        return self.drives.where(F.col("drive_id") == drive_id).first().drive_ord

    def add(self, chunks: DataFrame, drive_ord: int) -> None:
        """Appends the chunks (chunk_id) that no drive is known to have."""
        fresh = index.add(self.run, self.delta, chunks, drive_ord)
        fresh.write.mode("append").parquet(f"{self.root}/delta/{self.generation}")

    def compact(self) -> DataFrame:
        """Writes the next run, sorted by chunk, and returns it."""
        index.compact(self.run, self.delta).write.mode("overwrite").parquet(f"{self.root}/run/{self.generation + 1}")
        return self.run

    def locate(self, references: DataFrame) -> DataFrame:
        return index.locate(references, self.run, self.delta)
