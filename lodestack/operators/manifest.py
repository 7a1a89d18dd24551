"""Snapshots: ordered chunk lists per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build(chunks: DataFrame, size: str = "raw_size", complete: Column | None = None) -> DataFrame:
    """(path, bytes, chunks, complete) from chunks (path, pos, chunk_id, size); ids in order, repeats kept."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda x: x["chunk_id"])
    done = F.bool_and(complete) if complete is not None else F.lit(True)
    return chunks.groupBy("path").agg(F.sum(size).cast("long").alias("bytes"), ordered.alias("chunks"), done.alias("complete"))


def references(manifest: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, pos, chunk_id) in stored order."""
    return manifest.select(*keep, "path", F.posexplode("chunks").alias("pos", "chunk_id"))


def selected(manifest: DataFrame, only_file: str | None = None, only_prefix: str | None = None) -> DataFrame:
    """Filters that reach the scan; both given: both must hold; blank ones are off."""
    if only_file:
        manifest = manifest.where(F.col("path") == only_file)
    if only_prefix:
        manifest = manifest.where(F.startswith("path", F.lit(only_prefix)))
    return manifest


def snapshots(manifests: DataFrame) -> DataFrame:
    """Names of all snapshots, sorted."""
    return manifests.select("snapshot").distinct().orderBy("snapshot")


def latest(manifests: DataFrame, by: str = "drive_ord") -> DataFrame:
    """The last snapshot of each drive; names sort as time does."""
    return manifests.groupBy(by).agg(F.max("snapshot").alias("snapshot"))


def find(manifests: DataFrame, prefix: str) -> DataFrame:
    """The one snapshot whose name begins with ``prefix``; several or none is an error when the result is read."""
    found = manifests.where(F.startswith("snapshot", F.lit(prefix))).select("snapshot").distinct()
    one = found.agg(F.count("*").alias("n"), F.max("snapshot").alias("snapshot"))
    message = F.concat(F.lit(f"snapshot prefix '{prefix}' matches "), F.col("n").cast("string"))
    return one.select(F.when(F.col("n") == 1, F.col("snapshot")).otherwise(F.raise_error(message).cast("string")).alias("snapshot"))


def preferred(manifests: DataFrame) -> DataFrame:
    """Per snapshot the manifest to read: that of the first drive, there the encrypted one.

    manifests: (snapshot, drive_rank, encrypted, ...) one row per manifest file.
    """
    rest = [c for c in manifests.columns if c != "snapshot"]
    order = F.struct(F.col("drive_rank"), (~F.col("encrypted")).alias("plain"))
    return manifests.groupBy("snapshot").agg(F.min_by(F.struct(*rest), order).alias("x")).select("snapshot", *[f"x.{c}" for c in rest])


def union_latest(manifests: DataFrame, by_time: bool = False, drive: str = "drive_ord") -> DataFrame:
    """The latest snapshots of all drives as one tree; on the same path the drive attached later wins (or the later snapshot)."""
    newest = latest(manifests, drive).select(F.col(drive).alias("d"), F.col("snapshot").alias("s"))
    rows = manifests.join(newest, (F.col(drive) == F.col("d")) & (F.col("snapshot") == F.col("s"))).drop("d", "s")
    rest = [c for c in rows.columns if c != "path"]
    order = F.struct("snapshot", drive) if by_time else F.struct(drive)
    return rows.groupBy("path").agg(F.max_by(F.struct(*rest), order).alias("x")).select("path", *[f"x.{c}" for c in rest])
