"""A repository of snapshots: the commands of the engine as methods over tables in one folder."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack import schemas
from lodestack.functions.scalar import MANIFEST_MAGIC, PARITY_MAGIC, file_id, next_pow2, seal, try_unseal, unseal
from lodestack.operators import chunking, dedupe, index, inventory, manifest, parity, restore, verify
from lodestack.sources import sinks

DEFAULTS = {"rs_k": 8, "rs_r": 2, "least": 256 << 10, "average": 1 << 20, "most": 4 << 20, "window": 64, "algorithm": "fast", "compress": False, "encrypt": False, "encrypt_manifest": True, "obfuscate_parity": False}
_SETTINGS = "repo_id string, repo_name string, drive_id string, drive_ord int, label string, rs_k int, rs_r int, least int, average int, most int, window int, algorithm string, compress boolean, encrypt boolean, encrypt_manifest boolean, obfuscate_parity boolean"


class Repo:
    """One drive of a repository. Opening one that does not exist is an error; ``create`` makes it.

    With ``encrypt`` chunks and parity are sealed, and so is every row of a manifest unless ``encrypt_manifest`` is off.
    With ``obfuscate_parity`` and a key the names of per-file stripes are keyed, so that nobody can guess paths from them.
    """

    def __init__(self, spark: SparkSession, root: str, key: bytes | None = None):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.settings = spark.read.schema(_SETTINGS).parquet(f"{self.root}/settings").first()
        if self.settings.encrypt and key is None:
            raise ValueError("this repository is encrypted: a key is needed")

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str, repo_id: str | None = None, drive_ord: int = 0, label: str = "", key: bytes | None = None, **params) -> Repo:
        """``repo_id`` is shared by the drives of a repository: pass that of the first to the others."""
        values = {**DEFAULTS, **params}
        chunking.Params(values["algorithm"], values["least"], values["average"], values["most"], values["window"]).checked()
        row = (repo_id or str(uuid.uuid4()), name, str(uuid.uuid4()), drive_ord, label or root, *[values[c] for c in DEFAULTS])
        spark.createDataFrame([row], _SETTINGS).write.mode("errorifexists").parquet(f"{root.rstrip('/')}/settings")
        return cls(spark, root, key)

    def _table(self, name: str, schema: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    @property
    def chunks(self) -> DataFrame:
        return self._table("chunks", schemas.CHUNKS)

    @property
    def catalog(self) -> DataFrame:
        """A projection of the chunk table: payloads are not read."""
        return self.chunks.select("chunk_id", "stored_size")

    @property
    def manifests(self) -> DataFrame:
        if self._sealed_manifests:
            rows = self._table("manifests_sealed", "content BINARY, snapshot STRING")
            opened = F.from_json(unseal("content", self.key, MANIFEST_MAGIC).cast("string"), _TREE)
            tree = rows.select(opened.alias("x"), "snapshot").select("x.*", "snapshot")
        else:
            tree = self._table("manifests", f"{_TREE}, snapshot STRING")
        return tree.withColumn("drive_ord", F.lit(self.settings.drive_ord))

    @property
    def _sealed_manifests(self) -> bool:
        return bool(self.settings.encrypt and self.settings.encrypt_manifest)

    @property
    def stripes(self) -> DataFrame:
        """Parity in clear; a shard that does not open is null, which is a lost one."""
        return self._opened(self._table("stripes", schemas.STRIPES))

    @property
    def file_stripes(self) -> DataFrame:
        """Stripes of neighbours in one file; stripe_id is the file's id, its version's and the stripe's number."""
        return self._opened(self._table("file_stripes", schemas.FILE_STRIPES))

    def _opened(self, rows: DataFrame) -> DataFrame:
        if self.settings.encrypt:
            rows = rows.withColumn("parity", F.transform("parity", lambda p: try_unseal(p, self.key, PARITY_MAGIC)))
        return rows

    @property
    def params(self) -> chunking.Params:
        s = self.settings
        return chunking.Params(s.algorithm, s.least, s.average, s.most, s.window)

    def info(self) -> DataFrame:
        counts = self.catalog.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("stored_size"), F.lit(0)).alias("stored_bytes"))
        return self.spark.read.schema(_SETTINGS).parquet(f"{self.root}/settings").join(counts)

    def snapshots(self) -> DataFrame:
        return manifest.snapshots(self.manifests)

    def backup(self, files: DataFrame, snapshot: str | None = None, located: DataFrame | None = None, cap: int | None = None) -> DataFrame:
        """Stores files (path, content) and returns the counters. located: chunks that other drives have (chunk_id).

        Payloads are never shuffled: ids are, and files are cut a second time for the chunks that are to be written.
        """
        snapshot = snapshot or datetime.now(UTC).strftime("SNAP_%Y-%m-%dT%H-%M-%SZ")
        ids = chunking.chunk_files(files, self.params, payloads=False).drop("payload")
        known = self.catalog.select("chunk_id")
        if located is not None:
            known = known.unionByName(located.select("chunk_id"))
        from lodestack.session import cut

        state = cut(dedupe.with_state(ids, known, ["path", "pos"]))
        if cap is not None:
            new = F.when(F.col("is_new"), F.col("raw_size")).otherwise(0)
            kept = dedupe.under_cap(state, cap, ["path", "pos"], new, blocks="path")
            sizes = state.groupBy(F.col("path").alias("p")).agg(F.count("*").alias("all"))
            state = cut(kept.join(sizes, F.col("path") == F.col("p")).withColumn("whole", F.count("*").over(_by_path()) == F.col("all")).drop("p", "all"))
        else:
            state = state.withColumn("whole", F.lit(True))
        fresh = state.where("is_new").select(F.col("path").alias("p"), F.col("pos").alias("n"))
        again = chunking.chunk_files(files, self.params)
        payloads = again.join(fresh, (F.col("path") == F.col("p")) & (F.col("pos") == F.col("n")), "left_semi")
        sinks.append_chunks(verify.encode_payload(payloads, self.settings.compress, self.key if self.settings.encrypt else None), f"{self.root}/chunks")
        rows = manifest.build(state, complete=F.col("whole"))
        empty = files.where(F.coalesce(F.octet_length("content"), F.lit(0)) == 0).select("path", F.lit(0).cast("long").alias("bytes"), F.array().cast("array<string>").alias("chunks"), F.lit(True).alias("complete"))
        rows = rows.unionByName(empty)
        if self._sealed_manifests:
            line = F.to_json(F.struct("path", "bytes", "chunks", "complete"))
            sinks.write_manifest(rows.select(seal(line, self.key, MANIFEST_MAGIC).alias("content")), f"{self.root}/manifests_sealed", snapshot)
        else:
            sinks.write_manifest(rows, f"{self.root}/manifests", snapshot)
        return dedupe.totals(state, F.col("is_new"))

    def payloads(self, strict: bool = True, ids: DataFrame | None = None) -> DataFrame:
        """Raw payloads; ids (chunk_id): of these only, which is decided before any payload moves."""
        rows = self.chunks
        if ids is not None:
            rows = rows.join(ids.select(F.col("chunk_id").alias("i")), F.col("chunk_id") == F.col("i"), "left_semi")
        return verify.decode_payload(rows, self.key, strict)

    def verify(self) -> DataFrame:
        """One status per chunk; ``verify.summary`` counts them."""
        return verify.chunk_status(self.payloads(strict=False))

    def add_parity(self, finalize: bool = False) -> DataFrame:
        """Puts chunks that are in no stripe into stripes of K, writes R parity shards each, returns what still waits."""
        members = self.stripes.select(F.explode("chunks").alias("chunk_id"))
        backlog = parity.sweep_backlog(self.catalog, self.catalog, members)
        assigned = parity.assign_across_files(backlog, self.settings.rs_k, ["chunk_id"], parity.next_stripe(self.stripes))
        full, waiting = parity.split_pending(assigned, self.settings.rs_k, finalize)
        data = full.join(self.payloads().select(F.col("chunk_id").alias("c"), "payload"), F.col("chunk_id") == F.col("c")).select("stripe_id", F.col("pos").alias("slot"), "chunk_id", "payload")
        stripes = parity.encode(data, self.settings.rs_k, self.settings.rs_r, ["stripe_id"])
        self._sealed(stripes).write.mode("append").parquet(f"{self.root}/stripes")
        return waiting

    def _sealed(self, stripes: DataFrame) -> DataFrame:
        if self.settings.encrypt:
            stripes = stripes.withColumn("parity", F.transform("parity", lambda p: seal(p, self.key, PARITY_MAGIC)))
        return stripes

    def add_file_parity(self, snapshot: str) -> None:
        """Parity over each K neighbours of every file of a snapshot, where this drive has all of them.

        A version of a file (the same path and chunks) is striped once, whatever snapshots hold it.
        """
        from lodestack.session import cut

        name = file_id("path", self.key, self.settings.obfuscate_parity)
        version = F.substring(F.sha2(F.array_join("chunks", ","), 256), 1, 16)
        tree = self.manifests.where(F.col("snapshot") == snapshot).select(F.concat_ws(":", name, version).alias("file"), F.posexplode("chunks").alias("pos", "chunk_id"))
        slots = parity.assign_in_file(tree, self.settings.rs_k)
        slots = slots.select(F.concat_ws(":", "file", F.col("stripe").cast("string")).alias("stripe_id"), "slot", "chunk_id").distinct()
        done = self._table("file_stripes", schemas.FILE_STRIPES).select(F.col("stripe_id").alias("d"))
        slots = cut(slots.join(done, F.col("stripe_id") == F.col("d"), "left_anti"))
        whole = parity.all_local(slots, self.catalog, ["stripe_id"]).where("complete").select(F.col("stripe_id").alias("w"))
        data = slots.join(whole, F.col("stripe_id") == F.col("w"), "left_semi")
        rows = self.payloads(ids=data.select("chunk_id").distinct()).select(F.col("chunk_id").alias("c"), "payload")
        data = data.join(rows, F.col("chunk_id") == F.col("c")).drop("c")
        stripes = parity.encode(data, self.settings.rs_k, self.settings.rs_r, ["stripe_id"])
        self._sealed(stripes).write.mode("append").parquet(f"{self.root}/file_stripes")

    def verify_parity(self, of_files: bool = False) -> DataFrame:
        """(stripe_id, row, ok): whether each stored shard opens and equals what its chunks encode to."""
        stripes = self.file_stripes if of_files else self.stripes
        slots = stripes.select("stripe_id", F.posexplode("chunks").alias("slot", "chunk_id")).where("chunk_id IS NOT NULL")
        rows = self.payloads(strict=False, ids=slots).select(F.col("chunk_id").alias("c"), "payload")
        return parity.unreadable(stripes, slots.join(rows, F.col("chunk_id") == F.col("c")).drop("c").where("payload IS NOT NULL"))

    def inventory(self, bits_per_element: int = 10) -> tuple[DataFrame, int, int]:
        """(filter rows, m_bits, k) of this drive."""
        rows = self.catalog.withColumn("drive_ord", F.lit(self.settings.drive_ord))
        m, k = inventory.sizes(rows, bits_per_element)
        return inventory.build(rows, next_pow2(m), k), m, k


def _by_path():
    from pyspark.sql import Window

    return Window.partitionBy("path")


_TREE = f"{schemas.MANIFEST}, complete BOOLEAN"


def restore_files(repos: list[Repo], snapshot: str | None = None, only_file: str | None = None, only_prefix: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, missing chunks, refused) of a snapshot, or of the union of the latest ones; earlier drives in the list come first.

    With missing chunks, pass more drives and call again: the result depends on the list alone. refused (path, bytes,
    reason): files that a cap cut short when they were backed up, and files whose size is not the recorded one; they are
    never handed out. What no drive has is repaired by stripes of its file or across files, whichever give it back. A drive that is passed twice counts once. Drives are chosen by ids, before any payload is read.
    """
    repos = list({r.settings.drive_id: r for r in reversed(repos)}.values())[::-1]
    trees = repos[0].manifests.withColumn("drive_rank", F.lit(0))
    for rank, repo in enumerate(repos[1:], 1):
        trees = trees.unionByName(repo.manifests.withColumn("drive_rank", F.lit(rank)))
    if snapshot is None:
        tree = manifest.union_latest(trees, drive="drive_rank")
    else:
        named = trees.where(F.col("snapshot") == snapshot)
        owner = named.select(F.min("drive_rank").alias("owner"))
        tree = named.join(owner, F.col("drive_rank") == F.col("owner"))
    tree = manifest.selected(tree, only_file, only_prefix).select("path", "bytes", "chunks", F.coalesce("complete", F.lit(True)).alias("complete"))
    whole = tree.where("complete")
    refs = manifest.references(whole.select("path", "chunks"))
    ids = stripes = None
    for rank, repo in enumerate(repos):
        rows = repo.catalog.select("chunk_id", F.lit(rank).alias("drive_rank"))
        ids = rows if ids is None else ids.unionByName(rows)
        for kind, group in (("file", repo.file_stripes), ("across", repo.stripes)):
            group = group.withColumn("stripe_id", F.concat_ws(":", F.lit(kind), F.lit(str(rank)), F.col("stripe_id").cast("string")))
            stripes = group if stripes is None else stripes.unionByName(group)
    lost = restore.unavailable(refs, ids).select("chunk_id").distinct()
    slots = stripes.select("stripe_id", F.explode("chunks").alias("chunk_id")).where("chunk_id IS NOT NULL")
    touched = slots.join(lost, "chunk_id", "left_semi").select("stripe_id").distinct()
    siblings = slots.join(touched, "stripe_id", "left_semi").select("chunk_id")
    repaired = parity.repair(stripes, _fetched(repos, ids, siblings), lost).dropDuplicates(["chunk_id"])
    located = restore.located(refs, _fetched(repos, ids, refs), [repaired])
    empty = whole.where(F.size("chunks") == 0).select("path", F.lit(bytearray()).alias("content"))
    made = restore.reassemble(located).unionByName(empty)
    sized = made.join(whole.select(F.col("path").alias("p"), "bytes"), F.col("path") == F.col("p"))
    fits = restore.size_matches(F.col("content"), F.col("bytes"))
    refused = tree.where("NOT complete").select("path", "bytes", F.lit("cut short by the cap").alias("reason"))
    refused = refused.unionByName(sized.where(~fits).select("path", "bytes", F.lit("another size than recorded").alias("reason")))
    return sized.where(fits).select("path", "content"), restore.missing(located), refused


def _fetched(repos: list[Repo], ids: DataFrame, wanted: DataFrame) -> DataFrame:
    """(chunk_id, payload) of wanted chunks, each from the first drive that has it."""
    first = ids.join(wanted.select(F.col("chunk_id").alias("w")).distinct(), F.col("chunk_id") == F.col("w"), "left_semi").groupBy("chunk_id").agg(F.min("drive_rank").alias("drive_rank"))
    out = None
    for rank, repo in enumerate(repos):
        rows = repo.payloads(ids=first.where(F.col("drive_rank") == rank)).select("chunk_id", "payload")
        out = rows if out is None else out.unionByName(rows)
    return out


def restore_plan(tree: DataFrame, run: DataFrame, delta: DataFrame, drives: DataFrame, only_file: str | None = None, only_prefix: str | None = None, max_drives: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(drives to attach, coverage) for what is selected of a manifest."""
    located = index.locate(manifest.references(manifest.selected(tree, only_file, only_prefix).select("path", "chunks")), run, delta)
    return index.plan(located, drives, max_drives), index.coverage(located)


def suggest(tree: DataFrame, filters: DataFrame, m_bits: int, k: int, max_drives: int | None = None) -> DataFrame:
    """Greedy choice of drives by their Bloom filters."""
    needed = manifest.references(tree.select("path", "chunks")).select("chunk_id").distinct()
    return inventory.greedy_cover(needed, inventory.probe(needed, filters, m_bits, k), max_drives)
