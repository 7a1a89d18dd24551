"""The driver's tables in the place of the engine's: documents are files, their lines are chunks, doc_id mod 4 is the drive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import chunking, dedupe

DRIVES = 4
K, R = 8, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text", F.col("text").cast("binary").alias("content"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, pos, line, raw_size, chunk_id): newline chunks of every document."""
    return chunking.chunk_lines(files(spark, sf_dir).drop("content"))


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).drop("line")


def first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New chunks: the first occurrence of every id; drive_ord is that of its document."""
    return dedupe.first_occurrences(ids(spark, sf_dir), ["doc_id", "pos"]).withColumn("drive_ord", (F.col("doc_id") % DRIVES).cast("int"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids(spark, sf_dir).select("chunk_id", (F.col("doc_id") % DRIVES).cast("int").alias("drive_ord")).distinct()


def drives(spark: SparkSession) -> DataFrame:
    n = F.col("id").cast("int")
    return spark.range(DRIVES).select(n.alias("drive_ord"), F.concat(F.lit("drive-"), n.cast("string")).alias("drive_id"), F.when(n < 3, F.concat(F.lit("/mnt/drive"), n.cast("string"))).alias("label"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files that change: each turn is a snapshot on one of the drives."""
    rows = table(spark, sf_dir, "conversations")
    name = F.format_string("SNAP_2025-01-%02dT00-00-00Z", (F.col("turn") + 1).cast("int"))
    return rows.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path"), (F.col("turn") % DRIVES).cast("int").alias("drive_ord"), name.alias("snapshot"), F.sha2("text", 256).alias("chunk_id"))


def run_and_delta(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Index run from even documents; delta from odd ones and, as repeats on another drive, every tenth even one."""
    f = first(spark, sf_dir)
    run = f.where("doc_id % 2 = 0").select("chunk_id", "drive_ord")
    delta = f.where("doc_id % 2 = 1").select("chunk_id", "drive_ord").unionByName(f.where("doc_id % 10 = 0").select("chunk_id", ((F.col("drive_ord") + 1) % DRIVES).alias("drive_ord")))
    return run, delta
