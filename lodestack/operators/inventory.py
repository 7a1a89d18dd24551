"""Bloom filters per drive, membership, and the greedy choice of drives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.scalar import bloom_positions, bloom_size, is_chunk_id
from lodestack.session import cut

#: The most bits of one row of a filter table: what ``bitmap_construct_agg`` packs.
BUCKET = 32768


def positions(catalog: DataFrame, m_bits: int, k: int, keys: tuple[str, ...] = ("drive_ord",)) -> DataFrame:
    """(keys, position): set bits, each once."""
    valid = catalog.where(is_chunk_id("chunk_id"))
    return valid.select(*keys, F.explode(bloom_positions("chunk_id", m_bits, k)).alias("position")).distinct()


def build(catalog: DataFrame, m_bits: int, k: int, keys: tuple[str, ...] = ("drive_ord",)) -> DataFrame:
    """(keys, bucket, bits): the filter in rows of 4 KB, combined on the map side; no filter is ever in one task."""
    valid = catalog.where(is_chunk_id("chunk_id"))
    bit = valid.select(*keys, F.explode(bloom_positions("chunk_id", m_bits, k)).alias("p0")).withColumn("p", F.col("p0") + 1)
    return bit.groupBy(*keys, F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))


def probe(ids: DataFrame, filters: DataFrame, m_bits: int, k: int, keys: tuple[str, ...] = ("drive_ord",)) -> DataFrame:
    """(keys, chunk_id) of what a filter may hold: an equi-join on buckets, then a count of the bits that are set."""
    bit = ids.select("chunk_id").distinct().select("chunk_id", F.posexplode(bloom_positions("chunk_id", m_bits, k)).alias("i", "p0")).select("chunk_id", "i", (F.col("p0") + 1).alias("p"))
    bit = bit.select("chunk_id", "i", F.bitmap_bucket_number("p").alias("b"), F.bitmap_bit_position("p").alias("at"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 AS int) + 1, 1)")), 16, 10).cast("int")
    hit = bit.join(filters, F.col("b") == F.col("bucket")).where(F.expr("1").bitwiseAND(F.call_function("shiftright", byte, F.expr("cast(at % 8 AS int)"))) == 1)
    return hit.groupBy(*keys, "chunk_id").agg(F.count("*").alias("n")).where(F.col("n") == k).drop("n")


def sizes(catalog: DataFrame, bits_per_element: int = 10, max_k: int = 30) -> tuple[int, int]:
    """(m_bits, k) for the largest drive, so that filters of all drives are alike."""
    row = catalog.groupBy("drive_ord").count().agg(F.max("count").alias("n")).first()
    return bloom_size(row.n or 1, bits_per_element, max_k)


def greedy_cover(needed: DataFrame, holds: DataFrame, max_drives: int | None = None, rank: str = "drive_ord") -> DataFrame:
    """(step, drive, covers): each round the drive with most of what is left, ties to the first; ends when nothing is gained.

    needed: (chunk_id); holds: (chunk_id, drive), exact or from ``probe``. Each round is one aggregate and one anti join,
    checkpointed, so plans do not grow; there are no more rounds than drives.
    """
    spark = needed.sparkSession
    left = needed.select("chunk_id").distinct().join(holds.select("chunk_id", rank).distinct(), "chunk_id")
    left = cut(left)
    steps: list[tuple[int, int, int]] = []
    while max_drives is None or len(steps) < max_drives:
        best = left.groupBy(rank).agg(F.count("*").alias("covers")).orderBy(F.desc("covers"), F.asc(rank)).first()
        if best is None:
            break
        steps.append((len(steps) + 1, best[rank], best.covers))
        taken = left.where(F.col(rank) == best[rank]).select(F.col("chunk_id").alias("t"))
        left = cut(left.join(taken, F.col("chunk_id") == F.col("t"), "left_anti"))
    return spark.createDataFrame(steps, f"step int, {rank} int, covers long")
