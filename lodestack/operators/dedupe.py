"""Which chunks are new: anti and semi joins on chunk ids, never on payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST = "first_seen"


def first_occurrences(chunks: DataFrame, order: list[str], key: str = "chunk_id") -> DataFrame:
    """One row per chunk id, the first by ``order``.

    An aggregate (with map-side combine) instead of a window: a chunk that everybody has is no hot partition.
    """
    rest = [c for c in chunks.columns if c not in (key, *order)]
    first = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("x")
    return chunks.groupBy(key).agg(first).select(key, *[f"x.{c}" for c in (*order, *rest)])


def new_chunks(incoming: DataFrame, known: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows whose id is not known: what a backup must write."""
    return incoming.join(known.select(F.col(key).alias("known")).distinct(), F.col(key) == F.col("known"), "left_anti")


def reused_chunks(incoming: DataFrame, known: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows whose id is known already: references only."""
    return incoming.join(known.select(F.col(key).alias("known")).distinct(), F.col(key) == F.col("known"), "left_semi")


def with_state(incoming: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """incoming with ``is_new``: first occurrence of an id that is not known. All other rows are references."""
    fresh = first_occurrences(new_chunks(incoming, known).select("chunk_id", *order), order).select(F.col("chunk_id").alias("new_id"), *[F.col(c).alias(f"new_{c}") for c in order])
    same = F.col("chunk_id") == F.col("new_id")
    for c in order:
        same = same & (F.col(c) == F.col(f"new_{c}"))
    return incoming.join(fresh, same, "left").withColumn("is_new", F.col("new_id").isNotNull()).drop("new_id", *[f"new_{c}" for c in order])


def totals(chunks: DataFrame, is_new: Column, size: str = "raw_size") -> DataFrame:
    """Counters of one run: files, chunks, new and reused chunks, bytes read and bytes to write."""
    return chunks.agg(
        F.countDistinct("path").alias("files"),
        F.count("*").alias("chunks"),
        F.count_if(is_new).alias("new_chunks"),
        F.count_if(~is_new).alias("reused_chunks"),
        F.coalesce(F.sum(size), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.when(is_new, F.col(size))), F.lit(0)).alias("new_bytes"),
    )


def effective_cap(target_bytes: int | None, free_bytes: int, fill: float | None) -> int | None:
    """The smaller of the byte target and the share of free space that may be filled; None for no cap."""
    by_fill = int(free_bytes * fill) if fill and 0 < fill <= 1 else None
    caps = [c for c in (target_bytes, by_fill) if c is not None]
    return min(caps) if caps else None


def under_cap(chunks: DataFrame, cap: int, order: list[str], new_bytes: Column, blocks: str | None = None) -> DataFrame:
    """Rows up to and with the first at which the bytes written so far reach the cap; a cap of 0 still takes one.

    With ``blocks`` (a column that is ascending in ``order``, such as the file number) sums are taken per block first and
    only one row per block goes through the global running sum; chunks are summed within their block.
    """
    if blocks is None:
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        summed = chunks.withColumns({"before": F.coalesce(F.sum(new_bytes).over(before), F.lit(0)), "nth": F.row_number().over(Window.orderBy(*order))})
        return summed.where((F.col("before") < cap) | (F.col("nth") == 1)).drop("before", "nth")
    sums = chunks.groupBy(blocks).agg(F.sum(new_bytes).alias("block_bytes"))
    ahead = Window.orderBy(blocks).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(blocks).alias("b"), F.coalesce(F.sum("block_bytes").over(ahead), F.lit(0)).alias("base"), (F.row_number().over(Window.orderBy(blocks)) == 1).alias("opens"))
    inside = Window.partitionBy(blocks).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = chunks.withColumn("within", F.coalesce(F.sum(new_bytes).over(inside), F.lit(0))).withColumn("nth", F.row_number().over(Window.partitionBy(blocks).orderBy(*order))).join(sums, F.col(blocks) == F.col("b"))
    kept = joined.where((F.col("base") + F.col("within") < cap) | (F.col("opens") & (F.col("nth") == 1)))
    return kept.drop("b", "base", "opens", "within", "nth")
