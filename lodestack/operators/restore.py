"""Files from chunks: join, repair, reassemble, and a report of what is missing."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_attached(chunks: DataFrame, rank: str = "drive_rank") -> DataFrame:
    """One copy of each chunk: that of the drive attached first."""
    rest = [c for c in chunks.columns if c not in ("chunk_id", rank)]
    return chunks.groupBy("chunk_id").agg(F.min_by(F.struct(rank, *rest), rank).alias("x")).select("chunk_id", f"x.{rank}", *[f"x.{c}" for c in rest])


def located(references: DataFrame, chunks: DataFrame, repaired: list[DataFrame] | None = None) -> DataFrame:
    """references with payload, or null: from a drive, else from each table of repaired chunks (chunk_id, payload) in turn."""
    out = references.join(chunks.select(F.col("chunk_id").alias("c0"), F.col("payload").alias("p0")), F.col("chunk_id") == F.col("c0"), "left")
    names = ["p0"]
    for k, table in enumerate(repaired or [], 1):
        out = out.join(table.select(F.col("chunk_id").alias(f"c{k}"), F.col("payload").alias(f"p{k}")), F.col("chunk_id") == F.col(f"c{k}"), "left")
        names.append(f"p{k}")
    return out.select(*references.columns, F.coalesce(*names).alias("payload"))


def missing(located_references: DataFrame) -> DataFrame:
    """Chunks that no attached drive and no parity can give: attach more drives and call again."""
    return located_references.where("payload IS NULL").groupBy("chunk_id").agg(F.count("*").alias("references"))


def unavailable(references: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same without reading payloads."""
    return references.join(chunks.select(F.col("chunk_id").alias("c")).distinct(), F.col("chunk_id") == F.col("c"), "left_anti")


def reassemble(located_references: DataFrame) -> DataFrame:
    """(path, content) of files all of whose chunks are there, in order; files without chunks are not listed here."""
    whole = located_references.groupBy("path").agg(F.bool_and(F.col("payload").isNotNull()).alias("complete"), F.expr("listagg(payload) WITHIN GROUP (ORDER BY pos)").alias("content"))
    return whole.where("complete").select("path", "content")


def offsets(references: DataFrame, size: str = "raw_size") -> DataFrame:
    """Where in its file each chunk begins."""
    from pyspark.sql import Window

    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return references.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))


def size_matches(payload: Column, size: Column) -> Column:
    return F.octet_length(payload) == size


def safe_path(path: str) -> PurePosixPath:
    """A path below the destination; anything else is refused."""
    p = PurePosixPath(path)
    if p.is_absolute() or ".." in p.parts or not p.parts:
        raise ValueError(f"refusing to write {path!r}")
    return p


def write_files(files: DataFrame, destination: str) -> DataFrame:
    """Writes (path, content) below a folder that every executor mounts; returns (path, bytes) lazily as they are written."""
    from pathlib import Path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = Path(destination, safe_path(path))
                target.parent.mkdir(parents=True, exist_ok=True)
                part = target.with_name(target.name + ".tmp")
                part.write_bytes(content)
                part.replace(target)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return files.select("path", "content").mapInArrow(run, "path string, bytes long")
