"""Location index: which drive has a chunk. A sorted run and a delta; the run wins, since the first seen drive is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_of_delta(delta: DataFrame) -> DataFrame:
    """(chunk_id, drive_ord): of several lines for a chunk the last counts. delta: (chunk_id, drive_ord, line_no)."""
    return delta.where(F.length("chunk_id") == 64).groupBy("chunk_id").agg(F.max_by("drive_ord", "line_no").alias("drive_ord"))


def add(index: DataFrame, delta: DataFrame, chunks: DataFrame, drive_ord: int) -> DataFrame:
    """Rows to append to the delta: chunks that neither run nor delta has."""
    fresh = chunks.select("chunk_id").distinct()
    for known in (index, delta):
        fresh = fresh.join(known.select(F.col("chunk_id").alias("k")), F.col("chunk_id") == F.col("k"), "left_anti")
    return fresh.select("chunk_id", F.lit(drive_ord).alias("drive_ord"))


def compact(run: DataFrame, delta: DataFrame) -> DataFrame:
    """One sorted run: every chunk once, the run before the delta."""
    both = run.select("chunk_id", "drive_ord", F.lit(0).alias("age")).unionByName(delta.select("chunk_id", "drive_ord", F.lit(1).alias("age")))
    merged = both.groupBy("chunk_id").agg(F.min_by("drive_ord", F.struct("age", "drive_ord")).alias("drive_ord"))
    return merged.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id")


def locate(references: DataFrame, run: DataFrame, delta: DataFrame) -> DataFrame:
    """references with drive_ord, null where unknown."""
    r = run.select(F.col("chunk_id").alias("rc"), F.col("drive_ord").alias("ro"))
    d = delta.select(F.col("chunk_id").alias("dc"), F.col("drive_ord").alias("do"))
    joined = references.join(r, F.col("chunk_id") == F.col("rc"), "left").join(d, F.col("chunk_id") == F.col("dc"), "left")
    return joined.select(*references.columns, F.coalesce("ro", "do").alias("drive_ord"))


def tally(located: DataFrame) -> DataFrame:
    """(drive_ord, refs, chunks): references and different chunks by drive; unknown ones under null."""
    return located.groupBy("drive_ord").agg(F.count("*").alias("refs"), F.countDistinct("chunk_id").alias("chunks"))


def coverage(located: DataFrame) -> DataFrame:
    known = F.count_if(F.col("drive_ord").isNotNull())
    n = F.count("*")
    return located.agg(n.alias("needed"), known.alias("covered"), F.count_if(F.col("drive_ord").isNull()).alias("unknown"), F.round(F.when(n > 0, 100.0 * known / n), 2).alias("pct"))


def plan(located: DataFrame, drives: DataFrame, max_drives: int | None = None) -> DataFrame:
    """(drive_ord, refs, chunks, drive_id, label), best first; ties by ordinal; the drive table is one row per drive."""
    out = tally(located.where("drive_ord IS NOT NULL")).join(drives.select(F.col("drive_ord").alias("d"), "drive_id", "label"), F.col("drive_ord") == F.col("d"), "left").drop("d")
    out = out.withColumns({"drive_id": F.coalesce("drive_id", F.lit("")), "label": F.coalesce("label", F.lit(""))})
    out = out.orderBy(F.desc("refs"), F.asc("drive_ord"))
    return out.limit(max_drives) if max_drives is not None else out


def next_ordinal(drives: DataFrame, column: str = "drive_ord") -> DataFrame:
    return drives.agg((F.coalesce(F.max(column), F.lit(-1)) + 1).cast("long").alias("next"))


def register_drive(drives: DataFrame, drive_id: str, label: str) -> DataFrame:
    """The drive table with the drive added under the next ordinal, or its label renewed."""
    known = drives.select("drive_ord", "drive_id", F.when(F.col("drive_id") == drive_id, F.lit(label)).otherwise(F.col("label")).alias("label"))
    fresh = next_ordinal(drives).select(F.col("next").cast("int").alias("drive_ord"), F.lit(drive_id).alias("drive_id"), F.lit(label).alias("label"))
    there = drives.where(F.col("drive_id") == drive_id).select(F.lit(1).alias("x")).limit(1)
    return known.unionByName(fresh.join(there, F.lit(True), "left_anti"))
