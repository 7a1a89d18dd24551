"""Erasure coding: which chunks share a stripe, parity shards, repair, and what still waits for a full stripe."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import gf256
from lodestack.session import cut


def assign_in_file(chunks: DataFrame, k: int) -> DataFrame:
    """Stripes of ``k`` neighbours in a file: computed from the position, no shuffle. A last short stripe is padded by nothing."""
    return chunks.withColumns({"stripe": F.floor(F.col("pos") / k).cast("long"), "slot": (F.col("pos") % k).cast("int")})


def numbered(rows: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """rows with ``n``: 0, 1, ... by a global order, without bringing all rows into one task.

    Range partitions are sorted and counted; the counts (one per partition) give each its first number.
    """
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    counts = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("part").alias("p"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return placed.withColumn("at", inside).join(bases, F.col("part") == F.col("p")).withColumn("n", (F.col("base") + F.col("at") + start).cast("long")).drop("part", "p", "base", "at")


def assign_across_files(new_chunks: DataFrame, k: int, order: list[str], next_stripe: int = 0, pending: DataFrame | None = None) -> DataFrame:
    """new_chunks with stripe_id and pos: ``k`` chunks in order of arrival; ids only, payloads are joined per stripe.

    pending: the short stripe (chunk_id, n) that an earlier run carried over; it comes first.
    """
    carried = 0
    if pending is not None:
        carried = pending.count()
    out = numbered(new_chunks, order, carried)
    if carried:
        out = out.select("chunk_id", "n").unionByName(pending.select("chunk_id", F.col("n").cast("long").alias("n")))
    return out.withColumns({"stripe_id": (F.floor(F.col("n") / k) + next_stripe).cast("long"), "pos": (F.col("n") % k).cast("int")}).drop("n")


def split_pending(assigned: DataFrame, k: int, finalize: bool = False) -> tuple[DataFrame, DataFrame]:
    """(stripes to write, rows to carry over): a short last stripe waits unless it is to be finalised."""
    sizes = assigned.groupBy("stripe_id").agg(F.count("*").alias("size")).where(F.col("size") < k).select(F.col("stripe_id").alias("short"))
    if finalize:
        return assigned, assigned.limit(0)
    full = assigned.join(sizes, F.col("stripe_id") == F.col("short"), "left_anti")
    rest = assigned.join(sizes, F.col("stripe_id") == F.col("short"), "left_semi")
    return full, rest


def next_stripe(stripes: DataFrame, state: int | None = None) -> int:
    """From the stored state, else one more than the largest stripe."""
    if state is not None:
        return state
    return stripes.agg(F.coalesce(F.max("stripe_id") + 1, F.lit(0)).alias("n")).first().n


def all_local(assigned: DataFrame, local: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, complete): whether this drive has every chunk of the stripe."""
    have = local.select(F.col("chunk_id").alias("have")).distinct()
    return assigned.join(have, F.col("chunk_id") == F.col("have"), "left").groupBy(*keys).agg(F.bool_and(F.col("have").isNotNull()).alias("complete"))


def shard_sizes(assigned: DataFrame, keys: list[str], size: str = "raw_size") -> DataFrame:
    return assigned.groupBy(*keys).agg(F.max(size).cast("int").alias("shard_size"), F.count("*").alias("members"))


def sweep_backlog(catalog: DataFrame, store: DataFrame, stripe_index: DataFrame) -> DataFrame:
    """Chunks of the catalog that exist and are in no stripe yet."""
    out = catalog.select("chunk_id").where(F.length("chunk_id") == 64).distinct()
    out = out.join(store.select(F.col("chunk_id").alias("s")).distinct(), F.col("chunk_id") == F.col("s"), "left_semi")
    return out.join(stripe_index.select(F.col("chunk_id").alias("x")).distinct(), F.col("chunk_id") == F.col("x"), "left_anti")


def _members(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """At most K rows of a stripe meet; payloads come from the assignment's own rows."""
    return assigned.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("slot", "chunk_id", "payload"))).alias("members"))


def encode(assigned: DataFrame, k: int, r: int, keys: list[str]) -> DataFrame:
    """(keys, k, r, shard_size, chunks, sizes, parity) of stripes (keys, slot, chunk_id, payload). Empty slots are zeros."""
    stripes = _members(assigned, keys)
    schema = stripes.select(*keys).schema
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", k int, r int, shard_size int, chunks array<string>, sizes array<int>, parity array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for members in batch.column(len(keys)).to_pylist():
                length = max(len(m["payload"]) for m in members)
                data = np.zeros((k, length), np.uint8)
                chunks, sizes = [None] * k, [0] * k
                for m in members:
                    data[m["slot"], : len(m["payload"])] = np.frombuffer(m["payload"], np.uint8)
                    chunks[m["slot"]], sizes[m["slot"]] = m["chunk_id"], len(m["payload"])
                rows.append((k, r, length, chunks, sizes, [p.tobytes() for p in gf256.encode(data, r)]))
            types = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.binary()))
            c = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *[pa.array(list(x), t) for x, t in zip(c, types, strict=True)]], [*keys, "k", "r", "shard_size", "chunks", "sizes", "parity"])

    return stripes.mapInArrow(run, out)


def repair(stripes: DataFrame, chunks: DataFrame, wanted: DataFrame | None = None, key: str = "stripe_id") -> DataFrame:
    """(key, chunk_id, payload): chunks of the stripes that are not in ``chunks``, as far as parity gives them back.

    stripes: (key, k, r, shard_size, chunks, sizes, parity), null in ``parity`` for lost shards. chunks: (chunk_id,
    payload) of all attached drives. Rows are solved by their number, as many as there are erasures, and what comes out
    must hash to the chunk's id. wanted: (chunk_id) to repair; else all that are missing.
    """
    slots = stripes.select(key, F.posexplode("chunks").alias("slot", "chunk_id")).where("chunk_id IS NOT NULL AND chunk_id <> ''")
    if wanted is not None:
        touched = slots.join(wanted.select(F.col("chunk_id").alias("w")).distinct(), F.col("chunk_id") == F.col("w"), "left_semi").select(F.col(key).alias("t")).distinct()
        stripes = stripes.join(touched, F.col(key) == F.col("t"), "left_semi")
        slots = slots.join(touched, F.col(key) == F.col("t"), "left_semi")
    have = slots.join(chunks.select(F.col("chunk_id").alias("c"), "payload"), F.col("chunk_id") == F.col("c")).groupBy(key, "slot").agg(F.first("payload").alias("payload"))
    have = have.groupBy(F.col(key).alias("h")).agg(F.collect_list(F.struct("slot", "payload")).alias("have"))
    joined = stripes.join(have, F.col(key) == F.col("h"), "left").select(key, "shard_size", "chunks", "sizes", "parity", "have")
    kind = stripes.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stripe, length, ids, sizes, parity, have in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = {h["slot"]: h["payload"] for h in have or []}
                shards: list[np.ndarray | None] = []
                for slot, cid in enumerate(ids):
                    if cid and slot not in known:
                        shards.append(None)
                        continue
                    shard = np.zeros(length, np.uint8)
                    data = np.frombuffer(known.get(slot, b"")[:length], np.uint8)
                    shard[: len(data)] = data
                    shards.append(shard)
                lost = [s for s, x in enumerate(shards) if x is None]
                found = gf256.recover(shards, [None if p is None or len(p) != length else np.frombuffer(p, np.uint8) for p in parity]) if lost else None
                for s in lost if found else []:
                    payload = found[s][: sizes[s]].tobytes()
                    if hashlib.sha256(payload).hexdigest() == ids[s]:
                        rows.append((stripe, ids[s], payload))
            keys, ids, payloads = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(ids, pa.string()), pa.array(payloads, pa.binary())], [key, "chunk_id", "payload"])

    return joined.mapInArrow(run, f"{key} {kind}, chunk_id string, payload binary")


def lookup(ids: DataFrame, stripe_index: DataFrame) -> DataFrame:
    """(chunk_id, stripe_id, pos): the first entry by (drive_rank, line_no)."""
    first = stripe_index.groupBy("chunk_id").agg(F.min_by(F.struct("stripe_id", "pos"), F.struct("drive_rank", "line_no")).alias("x"))
    return ids.select("chunk_id").distinct().join(first, "chunk_id").select("chunk_id", "x.stripe_id", "x.pos")


def unreadable(stripes: DataFrame, members: DataFrame, key: str = "stripe_id") -> DataFrame:
    """(key, row, ok): whether each parity shard equals what its members encode to. members: (key, slot, chunk_id, payload)."""
    shapes = [(r.k, r.r) for r in stripes.select("k", "r").distinct().collect()]  # one or two: those of the settings
    if not shapes:
        return stripes.select(key, F.lit(0).alias("row"), F.lit(True).alias("ok")).limit(0)
    fresh = None
    for k, r in shapes:
        own = stripes.where((F.col("k") == k) & (F.col("r") == r)).select(F.col(key).alias("s"))
        some = encode(members.join(own, F.col(key) == F.col("s"), "left_semi"), k, r, [key]).select(F.col(key).alias("f"), F.posexplode("parity").alias("row", "want"))
        fresh = some if fresh is None else fresh.unionByName(some)
    stored = stripes.select(key, F.posexplode("parity").alias("stored_row", "shard"))
    return stored.join(fresh, (F.col(key) == F.col("f")) & (F.col("stored_row") == F.col("row")), "left").select(key, F.col("stored_row").alias("row"), F.coalesce(F.col("shard") == F.col("want"), F.lit(False)).alias("ok"))
