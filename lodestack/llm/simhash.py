"""SimHash near-duplicates by anchor-point covering.

A perfect Hamming code of covering radius 1 gives the anchors. Two fingerprints at distance t have a midpoint within
ceil(t/2) of both, and an anchor within 1 of that midpoint; so a fingerprint that is copied to every anchor within
1 + ceil(t/2) meets all its partners at some anchor. For t = 2 the lists reach to distance 2.

With the code of length 63 (2^57 anchors) a fingerprint has at most 32 anchors and an anchor holds only fingerprints
within 2 bits of it: no more than 2 * (1 + 63 + 1953) different ones, whatever the corpus. Equal fingerprints are
collapsed before they are copied, so a crowd of copies is one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import materialise, own_columns, read_table, texts_of
from lodestack.llm.graph import components

#: Shingles hashed at once; bounds the bit matrix.
BLOCK = 1 << 16
#: Nodes of one anchor that are compared at once.
HELD = 1 << 16


def shingle_hashes(text: bytes, n: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``n`` words (fewer words: of the whole sequence; none: nothing)."""
    words = text.split()
    if not words:
        return np.empty(0, np.uint64)
    n = min(n, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    count = len(words) - n + 1
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[:count].tolist(), ends[n - 1 :].tolist(), strict=True)), np.uint64, count)


def majority(hashes: np.ndarray) -> int:
    """Bit set where more than half of the hashes have it; nothing gives zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def shingle_fingerprints(docs: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, lo, hi): the 64-bit SimHash of ASCII-lower-cased whole texts in ``lo``, zero in ``hi``. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(shingle_hashes((t or b"").lower(), n, seed)) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), _signed(found), pa.array(np.zeros(len(found), np.int64))], ["doc_id", "lo", "hi"])

    return own_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lo long, hi long")


@cache
def _moves(m: int) -> list[np.ndarray]:
    """For each syndrome of the Hamming code of length 2^m - 1: what to xor to reach every codeword within distance 2."""
    n = (1 << m) - 1
    bit = [0] + [1 << (i - 1) for i in range(1, n + 1)]
    out = [np.zeros(1, np.uint64)]
    for s in range(1, n + 1):
        pairs = [bit[a] ^ bit[a ^ s] for a in range(1, n + 1) if a < a ^ s and a != s]
        out.append(np.array([bit[s], *pairs], np.uint64))
    return out


def anchors(values: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``values``, anchor) for every codeword within distance 2 of the low 2^m - 1 bits."""
    n = (1 << m) - 1
    values = values & np.uint64((1 << n) - 1)
    syndrome = np.zeros(len(values), np.int64)
    for j in range(m):
        has = np.uint64(sum(1 << (i - 1) for i in range(1, n + 1) if i >> j & 1))
        syndrome |= (np.bitwise_count(values & has) & 1).astype(np.int64) << j
    rows, found = [], []
    for s in np.unique(syndrome):
        at = np.flatnonzero(syndrome == s)
        move = _moves(m)[s]
        rows.append(np.repeat(at, len(move)))
        found.append((values[at][:, None] ^ move[None, :]).ravel())
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.empty(0, np.int64), np.empty(0, np.uint64))


def _keys(lo: np.ndarray, hi: np.ndarray, quarter: int | None) -> tuple[np.ndarray, np.ndarray]:
    """A code of length 63 over ``lo``; or one of length 31 over a quarter (32 bits) of both words."""
    if quarter is None:
        return anchors(lo, 6)
    return anchors((lo, hi)[quarter // 2] >> np.uint64(32 * (quarter % 2)), 5)


def _stars(lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(least member, all others) of each connected part of what is within ``most`` bits: never all pairs."""
    left = np.arange(len(ids))
    while len(left) > 1:
        stack, part, left = [left[0]], [left[:1]], left[1:]
        while stack and len(left):
            at = stack.pop()
            near = (np.bitwise_count(lo[left] ^ lo[at]) + np.bitwise_count(hi[left] ^ hi[at])) <= most
            if near.any():
                part.append(left[near])
                stack.extend(left[near])
                left = left[~near]
        if len(part) > 1:
            members = ids[np.concatenate(part)]
            least = members.min()
            yield int(least), members[members != least]


def anchor_links(nodes: DataFrame, most: int, quarter: int | None = None) -> DataFrame:
    """(u, v): links among nodes (node, lo, hi) that meet at an anchor; u is the least of its connected part there.

    Over the whole of ``lo`` (quarter None) they connect exactly what chains of distances of at most ``most`` (2) connect.
    Nodes are copied to their anchors, sorted by anchor, and compared anchor by anchor as a stream. An anchor of the whole
    code holds 4034 nodes at most; one of a quarter may hold more than ``HELD`` and is then compared in pieces of that size,
    with the least of each part carried from piece to piece.
    """

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                batch = whole.slice(at, 20_000)
                node, lo, hi = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                rows, keys = _keys(lo.view(np.uint64), hi.view(np.uint64), quarter)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(node[rows]), pa.array(lo[rows]), pa.array(hi[rows])], ["key", "node", "lo", "hi"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.empty(0, np.int64)] * 4
        for part in batches:
            held = [np.concatenate((r, part.column(k).to_numpy(zero_copy_only=False))) for k, r in enumerate(rest)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            yield from links([x[:cut] for x in held])
            rest = [x[cut:] for x in held]
            if len(rest[0]) > HELD:
                found = [*links(rest)]
                yield from found
                keep = np.isin(rest[1], np.concatenate([f.column(0).to_numpy() for f in found])) if found else np.zeros(len(rest[0]), bool)
                rest = [x[keep] for x in rest]
        yield from links(rest)

    def links(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, node = held[0], held[1]
        lo, hi = held[2].view(np.uint64), held[3].view(np.uint64)
        edges = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(key)]))
        crowded = np.flatnonzero(ends - starts > 1)
        found = [x for k in crowded for a, b in [(starts[k], ends[k])] for x in _stars(lo[a:b], hi[a:b], node[a:b], most)]
        if found:
            u = np.repeat(np.array([x for x, _ in found], np.int64), [len(v) for _, v in found])
            both = np.unique(np.c_[u, np.concatenate([v for _, v in found])], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["u", "v"])

    copied = nodes.select("node", "lo", "hi").mapInArrow(copy, "key long, node long, lo long, hi long")
    dealt = copied.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(compare, "u long, v long")


def classes(prints: DataFrame, most: int = 2) -> DataFrame:
    """prints (doc_id, lo, hi) with component_id: the smallest doc_id reachable over links of at most ``most`` bits.

    Equal fingerprints always share a component. Rows with a null doc_id take part through their fingerprint: it links
    others like any fingerprint. Where no row of a component has an id, component_id is null.
    """
    nodes = prints.groupBy("lo", "hi").agg(F.min("doc_id").alias("least"))
    # fingerprints stand for themselves: their own 64 bits are the node, so that those without a doc_id link too
    nodes = materialise(nodes.withColumn("node", F.col("lo")), "nodes")
    found = components(anchor_links(nodes, most), "u", "v")
    named = materialise(nodes.join(found, "node", "left").select("lo", "hi", "least", F.coalesce("component", "node").alias("part")), "named")
    ids = named.groupBy(F.col("part").alias("p")).agg(F.min("least").alias("component_id"))
    return prints.join(named.join(ids, F.col("part") == F.col("p")).select("lo", "hi", "component_id"), ["lo", "hi"])


def near_duplicates(docs: DataFrame, n: int = 3, seed: int = 42, most: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts, and texts without words, have fingerprint zero and are linked like any other. Texts shorter
    than ``n`` words are one shingle. Repeated rows stay repeated. An empty table gives an empty result. Columns other
    than doc_id and text are ignored.
    """
    prints = materialise(shingle_fingerprints(docs, n, seed), "prints")
    return classes(prints, most).select("doc_id", F.lpad(F.lower(F.hex("lo")), 16, "0").alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, links of 2 bits or fewer. Null and empty texts: fingerprint zero, linked like any other;
    repeated rows stay; an empty table gives an empty result."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
