"""Writers. Tables are Parquet, committed whole by Spark's protocol; legacy formats are written where others read them."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.scalar import MANIFEST_MAGIC, seal
from lodestack.sources.readers import INVENTORY_MAGIC


def append_chunks(chunks: DataFrame, path: str, fanout: int = 2) -> None:
    """Content-addressed put: (chunk_id, raw_size, stored_size, codec, payload), spread by the first hex digits of the id.

    The caller has taken out known ids; written ones are never changed.
    """
    out = chunks.select("chunk_id", "raw_size", "stored_size", "codec", "payload", F.substring("chunk_id", 1, fanout).alias("fan"))
    out.write.mode("append").partitionBy("fan").parquet(path)


def write_manifest(manifest: DataFrame, path: str, snapshot: str) -> None:
    """One snapshot: written once, by an atomic commit; ``snapshot`` becomes the partition."""
    manifest.withColumn("snapshot", F.lit(snapshot)).write.mode("append").partitionBy("snapshot").parquet(path)


def manifest_lines(manifest: DataFrame) -> DataFrame:
    """(value): the JSON lines that ``readers.manifests`` reads; any character of a path survives."""
    return manifest.orderBy("path").select(F.to_json(F.struct("path", "bytes", "chunks")).alias("value"))


def sealed_manifest(manifest: DataFrame, key: bytes) -> DataFrame:
    """(content): one sealed document of all lines of a snapshot, whose manifest is a few hundred bytes a file."""
    lines = manifest.select(F.struct("path", F.to_json(F.struct("path", "bytes", "chunks")).alias("line")).alias("x"))
    doc = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("doc"))
    return doc.select(seal(F.concat("doc", F.lit("\n")), key, MANIFEST_MAGIC).alias("content"))


def catalog_lines(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.concat_ws("\t", "chunk_id", F.col("stored_size").cast("string")).alias("value"))


def stripe_index_lines(assigned: DataFrame) -> DataFrame:
    return assigned.select(F.concat_ws("\t", "chunk_id", F.col("stripe_id").cast("string"), F.col("pos").cast("string")).alias("value"))


def index_delta_lines(rows: DataFrame) -> DataFrame:
    """(value): lines to append to an index delta, from (chunk_id, drive_ord)."""
    return rows.select(F.concat_ws("\t", "chunk_id", F.col("drive_ord").cast("string")).alias("value"))


def text_file(lines: DataFrame, path: str) -> None:
    """Ordered lines as one file of that name: written whole beside it, then renamed."""
    lines.coalesce(1).write.text(f"{path}.tmp")
    spark = lines.sparkSession
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    store = parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in store.listStatus(parent) if f.getPath().getName().startswith("part-"))
    if not store.rename(part, jvm.org.apache.hadoop.fs.Path(path)):
        raise FileExistsError(path)
    store.delete(parent, True)


def index_records(run: DataFrame) -> DataFrame:
    """(record): 33 bytes each, in order of the id."""
    return run.orderBy("chunk_id").select(F.concat(F.unhex("chunk_id"), F.unhex(F.lpad(F.hex("drive_ord"), 2, "0"))).alias("record"))


def line_manifest(manifest: DataFrame, snapshot: str, taken_at: str, host: str, params: str, algorithm: str) -> DataFrame:
    """(value): the older line format. manifest: (path, mode, bytes, chunks of id and size)."""
    body = manifest.select("path", F.concat(F.array(F.concat_ws(" ", F.lit("FILE"), "path", "mode", F.col("bytes").cast("string"))), F.transform("chunks", lambda c: F.concat_ws(" ", F.lit("CHUNK"), c["id"], c["size"].cast("string")))).alias("lines"))
    rows = body.select(F.lit(1).alias("part"), "path", F.posexplode("lines").alias("n", "value"))
    spark = manifest.sparkSession
    head = [(0, "", n, v) for n, v in enumerate((f"SNAPSHOT {snapshot} {taken_at} {host}", f"PARAMS {params}", f"ALGO {algorithm}"))]
    ends = spark.createDataFrame([*head, (2, "", 0, "END")], "part int, path string, n int, value string")
    return rows.unionByName(ends).orderBy("part", "path", "n").select("value")


def properties_text(values: dict[str, str]) -> str:
    return "".join(f"{k}={v}\n" for k, v in sorted(values.items()))


def inventory_bytes(repo_id: str, repo_name: str, drive_id: str, label: str, created_at: int, n: int, m_bits: int, k: int, bits: bytes) -> bytes:
    """The file that ``readers.parse_inventory`` reads."""
    texts = b"".join(struct.pack(">H", len(t.encode())) + t.encode() for t in (repo_id, repo_name, drive_id, label))
    return INVENTORY_MAGIC + texts + struct.pack(">qqiii", created_at, n, m_bits, k, len(bits)) + bits


def inventory_bits(filters: DataFrame, drive_ord: int, m_bits: int) -> bytes:
    """The filter of one drive as one byte string, from its rows of 4 KB; its size is m_bits / 8, fixed by the caller."""
    out = bytearray(m_bits // 8)
    for r in filters.where(F.col("drive_ord") == drive_ord).select("bucket", "bits").collect():
        at = (r.bucket - 1) * 4096
        out[at : at + 4096] = r.bits[: len(out) - at]
    return bytes(out)
