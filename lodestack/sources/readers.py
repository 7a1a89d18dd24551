"""Scans of every stored format. All are Spark reads, so any store that Spark reaches will do; schemas are explicit."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack import schemas
from lodestack.functions.scalar import MANIFEST_MAGIC, parse_stripe_name, slashes, unseal

#: What an inventory file and an index record begin with or are long.
INVENTORY_MAGIC, INDEX_RECORD = b"CSIV1", 33
ENCRYPTED, PLAIN = ".jsonl.gcm", ".jsonl"


def _below(path: Column, root: str) -> Column:
    """The path relative to ``root``, with forward slashes and without a scheme."""
    bare = root.rstrip("/").split("://", 1)[-1]
    bare = bare.removeprefix("file:")
    return slashes(F.regexp_replace(path, "^[a-z]+:/*" + (bare if not bare.startswith("/") else "/*" + bare.lstrip("/")).replace(".", r"\.") + "/?", ""))


def files(spark: SparkSession, root: str, glob: str | None = None, hidden: bool = True) -> DataFrame:
    """Regular files below ``root``: path (relative), length, modificationTime, content; unread columns cost nothing.

    Spark passes over empty files, names that begin with a dot or an underscore, and all below such folders;
    ``hidden_files`` adds them.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    seen = reader.load(root).withColumn("path", _below(F.col("path"), root)).select("path", "length", "modificationTime", "content")
    return seen.unionByName(hidden_files(spark, root, glob)) if hidden else seen


def _passed_over(parts: list[str], size: int) -> bool:
    """Whether Spark's own listing skips a file: empty, or hidden by its name or by that of a folder above it."""
    hidden = [(p.startswith("_") and "=" not in p) or p.startswith(".") or p.endswith("._COPYING_") for p in parts]
    above = [h and not p.startswith(("_common_metadata", "_metadata")) for h, p in zip(hidden[:-1], parts[:-1], strict=True)]
    return not size or hidden[-1] or any(above)


def hidden_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """The files below ``root`` that Spark's listing skips, with the columns of ``files``; symbolic links to files are left out.

    One task lists what is below a folder at the top; contents are read one file at a time.
    """
    from pyarrow import fs

    uri = root if "://" in root else root.replace("file:", "", 1) if root.startswith("file:") else root
    store, top = fs.FileSystem.from_uri(uri)
    tops = [(e.path, e.type == fs.FileType.Directory) for e in store.get_file_info(fs.FileSelector(top))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        from fnmatch import fnmatchcase

        here, base = fs.FileSystem.from_uri(uri)
        local = isinstance(here, fs.LocalFileSystem)
        cut = len(base.rstrip("/")) + 1
        for batch in batches:
            for path, is_folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for e in here.get_file_info(fs.FileSelector(path, recursive=True)) if is_folder else [here.get_file_info(path)]:
                    parts = e.path[cut:].split("/")
                    wanted = e.type == fs.FileType.File and _passed_over(parts, e.size) and (glob is None or fnmatchcase(parts[-1], glob))
                    if not wanted or (local and os.path.islink(e.path)):
                        continue
                    with here.open_input_stream(e.path) as f:
                        content = f.read()
                    columns = [pa.array(["/".join(parts)]), pa.array([len(content)], pa.int64()), pa.array([e.mtime], pa.timestamp("us", "UTC")), pa.array([content], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "length", "modificationTime", "content"])

    listed = spark.createDataFrame(tops, "path string, folder boolean")
    return listed.repartition(max(1, min(len(tops), 1000))).mapInArrow(run, schemas.FILES)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Plain manifests, one JSON object a line, with the snapshot that the file is named after."""
    name = F.regexp_extract("_metadata.file_name", r"^(.*)\.jsonl$", 1)
    return spark.read.schema(schemas.MANIFEST).option("pathGlobFilter", "*.jsonl").json(path).select("*", name.alias("snapshot"))


def encrypted_manifests(spark: SparkSession, path: str, key: bytes) -> DataFrame:
    """Encrypted manifests; a manifest is one sealed document."""
    docs = spark.read.format("binaryFile").option("pathGlobFilter", "*" + ENCRYPTED).load(path)
    name = F.regexp_extract("path", r"([^/]*)\.jsonl\.gcm$", 1)
    lines = docs.select(name.alias("snapshot"), F.explode(F.split(unseal("content", key, MANIFEST_MAGIC).cast("string"), "\n")).alias("line")).where("line <> ''")
    return lines.select(F.from_json("line", schemas.MANIFEST).alias("x"), "snapshot").select("x.*", "snapshot")


def snapshot_files(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot, encrypted) of every manifest file, sorted, without reading any."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl*").load(path).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    names = found.where(F.col("name").endswith(PLAIN) | F.col("name").endswith(ENCRYPTED))
    return names.select(F.regexp_replace("name", r"\.jsonl(\.gcm)?$", "").alias("snapshot"), F.col("name").endswith(ENCRYPTED).alias("encrypted")).orderBy("snapshot")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (chunk_id, stored_size); lines without a tab or with an id of another length are passed over."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(parts) >= 2).select(parts[0].alias("chunk_id"), parts[1].try_cast("long").alias("stored_size"))
    return rows.where(F.length("chunk_id") == 64)


def catalog_rows(spark: SparkSession, path: str) -> DataFrame:
    """The count of all lines, malformed and repeated ones too."""
    return spark.read.text(path).agg(F.count("*").alias("entries"))


def stripe_index(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (chunk_id, stripe_id, pos) with line numbers, the first of which counts."""
    return numbered_lines(spark, path).select(F.split("value", "\t").alias("p"), "line_no").where(F.size("p") == 3).select(F.col("p")[0].alias("chunk_id"), F.col("p")[1].cast("long").alias("stripe_id"), F.col("p")[2].cast("int").alias("pos"), "line_no")


def index_delta(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (chunk_id, drive_ord) with line numbers, the last of which counts."""
    return numbered_lines(spark, path).select(F.split("value", "\t").alias("p"), "line_no").where((F.size("p") == 2) & (F.length(F.col("p")[0]) == 64)).select(F.col("p")[0].alias("chunk_id"), F.col("p")[1].cast("int").alias("drive_ord"), "line_no")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value, line_no): lines of small control files with their numbers; each file is one row and one split."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value")).where("value <> ''")


def index_run(spark: SparkSession, path: str) -> DataFrame:
    """Sorted run of 33-byte records: 32 bytes of id, one of drive ordinal; cut into records wherever the file is split."""
    records = spark.sparkContext.binaryRecords(path, INDEX_RECORD).map(lambda r: (bytearray(r),))
    raw = spark.createDataFrame(records, "r binary")
    return raw.select(F.lower(F.hex(F.substring("r", 1, 32))).alias("chunk_id"), F.conv(F.hex(F.substring("r", 33, 1)), 16, 10).cast("int").alias("drive_ord"))


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Stripe descriptions, with the stripe number of their folder; an empty id is an empty slot."""
    stripe = parse_stripe_name(F.regexp_extract("_metadata.file_path", r"/(stripe-[^/]*)/sidecar\.json$", 1))
    rows = spark.read.schema(schemas.SIDECAR).option("recursiveFileLookup", "true").option("pathGlobFilter", "sidecar.json").json(path)
    slots = F.transform("chunks", lambda c: F.when(c != "", c))
    return rows.select(stripe.alias("stripe_id"), "k", "r", F.col("shardSize").alias("shard_size"), slots.alias("chunks"), "sizes")


def parity_shards(spark: SparkSession, path: str) -> DataFrame:
    """(folder, stripe_id, row, payload) of stored parity, per file or across files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "p_*").load(path)
    return rows.select(F.regexp_extract("path", r"^(.*)/stripe-[^/]*/[^/]*$", 1).alias("folder"), parse_stripe_name(F.regexp_extract("path", r"/(stripe-[^/]*)/[^/]*$", 1)).alias("stripe_id"), F.regexp_extract("path", r"/p_(\d+)$", 1).try_cast("int").alias("row"), F.col("content").alias("payload"))


def chunk_tree(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, payload) of a fan-out tree: files with names of 64 characters, whatever follows the dot."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.regexp_extract("path", r"([^/.]*)(\.chunk)?$", 1).alias("chunk_id"), F.col("content").alias("payload")).where(F.length("chunk_id") == 64)


def properties(spark: SparkSession, path: str, defaults: dict[str, str] | None = None) -> dict[str, str]:
    """A small ``key=value`` file, on the driver: repository settings, drive lists, packer state."""
    out = dict(defaults or {})
    for (text,) in spark.read.text(path, wholetext=True).collect():
        for line in text.splitlines():
            if line.strip() and line.lstrip()[0] not in "#!":
                key, _, value = line.partition("=")
                out[key.strip()] = value.strip().replace("\\:", ":").replace("\\=", "=").replace("\\\\", "\\")
    return out


def number(text: str) -> int:
    """Settings may write 1_048_576."""
    return int(text.replace("_", ""))


def inventories(spark: SparkSession, path: str, repo_id: str | None = None) -> DataFrame:
    """Bloom filter files: big-endian header, four length-prefixed strings, counts, then the bits. Another magic is an error.

    repo_id: those of one repository only.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.inv").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse_inventory(bytes(c), p) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            types = (*[pa.string()] * 4, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            names = ["repo_id", "repo_name", "drive_id", "label", "created_at", "n", "m_bits", "k", "bits"]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    rows = found.mapInArrow(run, schemas.INVENTORY).withColumn("created_at", F.timestamp_seconds("created_at"))
    return rows if repo_id is None else rows.where(F.col("repo_id") == repo_id)


def parse_inventory(content: bytes, name: str = "") -> tuple:
    if content[:5] != INVENTORY_MAGIC:
        raise ValueError(f"{name}: no inventory")
    at, texts = 5, []
    for _ in range(4):
        size = struct.unpack_from(">H", content, at)[0]
        texts.append(content[at + 2 : at + 2 + size].decode())
        at += 2 + size
    created, n, m, k, size = struct.unpack_from(">qqiii", content, at)
    return (*texts, created, n, m, k, content[at + 28 : at + 28 + size])


def line_manifests(spark: SparkSession, path: str) -> DataFrame:
    """The older line format: SNAPSHOT, PARAMS, ALGO, then FILE lines each followed by its CHUNK lines, up to END.

    Paths keep their spaces. One row per file: snapshot, path, mode, bytes, chunks (id, size).
    """
    from pyspark.sql import Window

    lines = numbered_lines(spark, path)
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = lambda pattern, group, kind: F.when(F.col("value").rlike(pattern), F.regexp_extract("value", pattern, group).cast(kind))
    file_line, chunk_line = r"^FILE (.*) (\S) (\d+)$", r"^CHUNK (\S+) (\d+)$"
    marked = lines.select(
        "file", "line_no", "value", F.last(head(r"^SNAPSHOT (\S+)", 1, "string"), True).over(order).alias("snapshot"), F.max(F.when(F.col("value") == "END", 1).otherwise(0)).over(order).alias("ended"),
        F.last(F.when(F.col("value").rlike(file_line), F.col("line_no")), True).over(order).alias("file_no"),
    ).where("ended = 0 AND file_no IS NOT NULL")
    chunk = F.when(F.col("value").rlike(chunk_line), F.struct("line_no", F.regexp_extract("value", chunk_line, 1).alias("id"), F.regexp_extract("value", chunk_line, 2).cast("long").alias("size")))
    rows = marked.groupBy("file", "snapshot", "file_no").agg(F.max(head(file_line, 1, "string")).alias("path"), F.max(head(file_line, 2, "string")).alias("mode"), F.max(head(file_line, 3, "long")).alias("bytes"), F.array_sort(F.collect_list(chunk)).alias("c"))
    return rows.select("snapshot", "path", "mode", "bytes", F.transform("c", lambda c: F.struct(c["id"].alias("id"), c["size"].alias("size"))).alias("chunks"))

