"""Connected components of a link table: by rounds over all executors while it is large, by one task as soon as it is small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lodestack.llm.common import forget, materialise

#: Links (16 bytes each) that one task joins at once. A round is some ten stages, whose plans and classes the driver holds.
FEW = 1 << 19


def _toward_minimum(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One star step: every vertex learns the least of its neighbours and passes it on.

    both_ways: neighbours on either side count and larger ones are re-linked (large star); else only smaller ones do
    (small star). Minima are partial aggregates and the join may be split by adaptive execution, so a hub is no hot spot.
    """
    seen = edges.select("u", "v")
    if both_ways:
        seen = seen.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    linked = seen.join(least, F.col("u") == F.col("c"))
    if both_ways:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node reachable from each) of links: roots hook onto the least root beside them, paths are cut short."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (further := root[root])).any():
            root = further
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _joined_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined(*map(np.concatenate, zip(*parts, strict=True)))], ["node", "component"])


def _mark(links: DataFrame) -> Row:
    """How many links, and which."""
    return links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link to another.

    While there are more than ``FEW`` links, alternates large-star and small-star steps until the link table stops changing,
    which it must; each round is written to the shared folder, so plans stay short and a lost executor costs one round at
    most. Null ends and self-links are ignored. Links need not be distinct.
    """
    kept = edges.select(F.greatest(left, right).cast("long").alias("u"), F.least(left, right).cast("long").alias("v"))
    kept = materialise(kept.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "links")
    before, mark = None, _mark(kept)
    while mark[0] > FEW and mark != before:
        after = materialise(_toward_minimum(_toward_minimum(kept, True), False), "links")
        before, mark = mark, _mark(after)
        forget(edges.sparkSession, kept)
        kept = after
    if mark[0] <= FEW:
        return kept.coalesce(1).mapInArrow(_joined_at_once, "node long, component long")
    found = kept.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = kept.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return found.unionByName(roots.join(found.select("node"), "node", "left_anti"))


def labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, held) for nodes (node): the least node reachable over links (u, v), itself included."""
    found = components(links, "u", "v").select(F.col("node").alias("k"), "component")
    return materialise(nodes.select("node").join(found, F.col("node") == F.col("k"), "left").select("node", F.coalesce("component", "node").alias("held")), "labels")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, held) after links (u, v) among nodes: groups that a link joins become one, named by its least member.

    Links inside a group are dropped before any round, so what has been joined is not joined again.
    """
    a, b = (labels.select(F.col("node").alias(n), F.col("held").alias(h)) for n, h in (("a", "x"), ("b", "y")))
    crossing = links.join(a, F.col("u") == F.col("a")).join(b, F.col("v") == F.col("b")).where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    crossing = materialise(crossing, "crossing")
    if crossing.isEmpty():
        return labels
    found = components(crossing, "x", "y").select(F.col("node").alias("k"), "component")
    return materialise(labels.join(found, F.col("held") == F.col("k"), "left").select("node", F.coalesce("component", "held").alias("held")), "labels")
