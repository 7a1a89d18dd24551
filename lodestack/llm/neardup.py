"""Near-duplicate documents on word shingles: SimHash gathers them, exact Jaccard similarity decides, nothing is lost.

1. SimHash over five-word shingles is too coarse at a similarity of 0.8: ten bits of 64 differ. Over the set of single words
   such texts are far closer, so the covering works on a 128-bit SimHash of the distinct words: four 32-bit quarters, each
   covered by a Hamming code of length 31 whose anchors bring together whatever is within 2 bits in that quarter. Texts of
   up to 11 differing bits always meet. After each quarter what is linked is contracted to one label.
2. Inside each group the five-word shingle sets are compared exactly, in tiles of bounded size: twice, cut differently, so
   that the tiles of a crowd of copies join to one class.
3. What the SimHash missed (a passage gained or lost moves more bits) and what the tiles parted is found by a prefix filter,
   which misses no pair of the similarity: with the shingles of all texts in one order, similar sets share one among their
   first ones. Members of different classes that meet there name the two tiles that hold them, and these are compared
   exactly. Copies that are one class by now name nothing; most groups are a tile each, with one or two members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import WordHashes, forget, freeing_shuffles, grams, in_groups, materialise, mix, texts_of
from lodestack.llm.graph import labelled, relabelled
from lodestack.llm.simhash import anchor_links, majority

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of 128 that word prints of SimHash candidates may differ in. Unrelated texts differ in about 50.
CANDIDATE_BITS = 22
#: Bits of 128 that shingle prints of a proposed pair may differ in. At a similarity of 0.8 the cosine of the sets is 0.889
#: or more, so 19.4 bits are expected at most, with a deviation of 4.1: 44 is six deviations off. Unrelated: 64.
PRINT_BITS = 44
#: Shingles in common cells come last in the order of the prefix filter. So many cells, by hash, are counted over all
#: documents (0: the order is that of the hashes alone); the order changes the number of candidates, never what is found.
COMMON_MOST = 1 << 16
#: Pairs held before they are handed on, and bytes of text whose shingles are.
PAIRS, CHUNK = 1 << 18, 1 << 20
#: Members of a group, and shingles of them, that are compared at once.
TILE, TILE_SHINGLES = 512, 1 << 21
#: Shingles per step of the comparison.
COLUMNS = 4096
_OTHER = np.uint64(0xA0761D6478BD642F)


def shingles_of(text: bytes | None, known: WordHashes, shingle: int = SHINGLE) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, their hashes, the set of hashes of runs of ``shingle`` words) of a text, ASCII letters lower-cased.

    Fewer words are one run; no words, none.
    """
    words = (text or b"").lower().split()
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return words, hashes, np.unique(grams(hashes, min(shingle, len(words)))) if words else np.empty(0, np.uint64)


def _print(hashes: np.ndarray) -> tuple[int, int]:
    """A 128-bit SimHash of a set of hashes."""
    return majority(mix(hashes)), majority(mix(hashes ^ _OTHER))


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """For each of ``COMMON_MOST`` cells, how many shingles have a hash with that remainder, in the sets of all documents."""
    cells = COMMON_MOST
    total = np.zeros(cells, np.int64)
    if not cells:
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = WordHashes(), np.zeros(cells, np.int64)
        for batch in batches:
            for texts in in_groups(((t or b"",) for t in texts_of(batch.column(0))), lambda r: len(r[0]), CHUNK):
                found = np.concatenate([shingles_of(t, known, shingle)[2] for (t,) in texts])
                counts += np.bincount((found % np.uint64(cells)).view(np.int64), minlength=cells)
        cell = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(counts[cell])], ["cell", "n"])

    with freeing_shuffles(docs.sparkSession):
        counted = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    return total


def described(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, t1, t2, lo, hi, s1, s2, n, keys), from one pass over the texts after one that counts shingles.

    t: 128-bit hash of the lower-cased words in order; lo, hi: SimHash of their set; s: SimHash of the shingle set; n: how
    many shingles it has; keys: the first of them, those of rare cells before those of common ones. A similar set of m
    shingles has similarity / (1 + similarity) * (n + m) in common with it at least, so the first one they share, in the
    order of all shingles, is among these keys on both sides.
    """
    weight = common_shingles(docs, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            rows, keys = [], []
            for text in texts_of(batch.column(1)):
                words, hashes, found = shingles_of(text, known, shingle)
                whole = xxhash.xxh128_intdigest(b" ".join(words))
                rows.append((whole >> 64, whole & (1 << 64) - 1, *_print(np.unique(hashes)), *_print(found), len(found)))
                if len(weight):
                    found = found[np.argsort(weight[(found % np.uint64(len(weight))).view(np.int64)], kind="stable")]
                keys.append(found[: len(found) - int(np.ceil(similarity * len(found) - 1e-6)) + 1].view(np.int64))
            columns = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, lists], ["doc_id", "t1", "t2", "lo", "hi", "s1", "s2", "n", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, t1 long, t2 long, lo long, hi long, s1 long, s2 long, n long, keys array<long>")


def candidate_groups(nodes: DataFrame, bits: int = CANDIDATE_BITS) -> DataFrame:
    """nodes (node, lo, hi) -> (node, held): chains of nodes that meet at anchors, named by their least.

    Equal prints are one before they are copied to anchors.
    """
    prints = materialise(nodes.groupBy("lo", "hi").agg(F.min("node").alias("node")), "word_prints")
    labels = labelled(prints, anchor_links(prints, bits, 0))
    rest = [anchor_links(prints, bits, quarter) for quarter in (1, 2, 3)]
    labels = relabelled(labels, rest[0].unionByName(rest[1]).unionByName(rest[2]))
    named = prints.join(labels, "node").select("lo", "hi", "held")
    return materialise(nodes.select("node", "lo", "hi").join(named, ["lo", "hi"]).select("node", "held"), "groups")


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets (sorted, distinct) have at least that Jaccard similarity. Two empty sets are alike."""
    sizes = np.array([len(s) for s in sets], np.float32)
    member = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.where(shared[column], (np.cumsum(shared) - 1)[column], -1)
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    for first in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[member[a:b], column[a:b] - first] = 1
        common += has @ has.T
    union = sizes[:, None] + sizes[None, :] - common
    return common >= np.float32(similarity) * union - 1e-3


def _stars(near: np.ndarray, ids: list[int]) -> Iterator[tuple[int, int]]:
    """(least member, other) of each connected part."""
    left = np.arange(len(ids))
    while len(left):
        stack, part, left = [left[0]], [left[0]], left[1:]
        while stack and len(left):
            hit = near[stack.pop(), left]
            part.extend(left[hit])
            stack.extend(left[hit])
            left = left[~hit]
        members = sorted(ids[k] for k in part)
        yield from ((members[0], m) for m in members[1:])


def _verified(members: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """members (unit, node, text), sorted by unit -> links (u, v): u is the least node of what is similar in its unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, current, ids, sets = WordHashes(), None, [], []

        def links() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                found = list(_stars(similar(sets, similarity), ids))
                if found:
                    u, v = np.array(found, np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            for unit, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                if unit != current:
                    yield from links()
                    current, ids, sets = unit, [], []
                ids.append(doc)
                sets.append(shingles_of(text, known, shingle)[2])
        yield from links()

    return members.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "u long, v long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (unit, node) with the node's text."""
    texts = docs.select(F.col("doc_id").alias("d"), "text")
    return texts.join(wanted, F.col("d") == F.col("node")).select("unit", "node", "text")


def _tiles(groups: DataFrame, turn: int) -> DataFrame:
    """groups (node, held, n) with tiles, how many its group has, and tile: one of them by a hash of the node and ``turn``."""
    wanted = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES))
    sizes = groups.groupBy(F.col("held").alias("h")).agg(wanted.cast("int").alias("tiles"), F.count("*").alias("size"))
    # a hash of node, not of the group, deals the rows: the join by group may be one key, and adaptive execution splits it
    joined = groups.join(sizes, F.col("held") == F.col("h"))
    return joined.select("node", "held", "n", "tiles", "size", F.xxhash64("held", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("tiles"))).alias("tile"))


def verified_classes(docs: DataFrame, tiled: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, held): classes of what is similar inside each tile, and in groups of several tiles inside those of a second cut."""
    crowds = tiled.where("size > 1")
    links = _verified(_texts(docs, crowds.select(F.col("tile").alias("unit"), "node")), shingle, similarity)
    again = _tiles(crowds.where("tiles > 1").select("node", "held", "n"), 1)
    more = _verified(_texts(docs, again.select(F.col("tile").alias("unit"), "node")), shingle, similarity)
    return labelled(tiled, links.unionByName(more))


def prefix_links(nodes: DataFrame, tiled: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """(x, y): tiles to compare, because a node of one and a node of the other, of different classes, may be similar.

    nodes (node, s1, s2, n, keys), tiled (node, tile), labels (node, held). Every similar pair meets under the first shingle
    it shares. There, what follows on either side must be as much as they have in common at least; and the shingle prints
    must agree but for ``PRINT_BITS``. Members of one tile have been compared.
    """
    share = similarity / (1 + similarity)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.empty(0, np.int64)] * 7
        for part in batches:
            held = [np.concatenate((r, part.column(k).to_numpy(zero_copy_only=False))) for k, r in enumerate(rest)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            yield from meet(*[x[:cut] for x in held])
            rest = [x[cut:] for x in held]
        yield from meet(*rest)

    def meet(key: np.ndarray, tile: np.ndarray, held: np.ndarray, n: np.ndarray, at: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> Iterator[pa.RecordBatch]:
        s1, s2 = s1.view(np.uint64), s2.view(np.uint64)
        edges = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(key)]))
        mixed = np.flatnonzero((np.diff(key) == 0) & (np.diff(held) != 0))
        out, size = [], 0
        for k in np.unique(np.searchsorted(starts, mixed, "right") - 1):
            a, b = starts[k], ends[k]
            # rows come by class; those of the largest class are only ever the other side
            names, counts = np.unique(held[a:b], return_counts=True)
            for i in np.flatnonzero(held[a:b] != names[counts.argmax()]) + a:
                ok = held[a:b] != held[i]
                ok &= np.minimum(n[i] - at[i], n[a:b] - at[a:b]) >= share * (n[i] + n[a:b]) - 1e-3
                ok &= np.bitwise_count(s1[a:b] ^ s1[i]) + np.bitwise_count(s2[a:b] ^ s2[i]) <= PRINT_BITS
                other = tile[a:b][ok]
                other = np.unique(other[other != tile[i]])
                if len(other):
                    out.append(np.c_[np.minimum(tile[i], other), np.maximum(tile[i], other)])
                    size += len(other)
                if size >= PAIRS:
                    yield batch_of(out)
                    out, size = [], 0
        if out:
            yield batch_of(out)

    def batch_of(out: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["x", "y"])

    own = nodes.join(labels, "node").join(tiled.select("node", "tile"), "node").select("tile", "held", "n", "s1", "s2", F.posexplode("keys").alias("at", "key"))
    dealt = own.select("key", "tile", "held", "n", F.col("at").cast("long").alias("at"), "s1", "s2").repartition("key").sortWithinPartitions("key", "held")
    return dealt.mapInArrow(pairs, "x long, y long").distinct()


def duplicate_classes(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, t1, t2, class_id) for every row with a doc_id: class_id is the smallest doc_id reachable over near-duplicates.

    Texts equal but for ASCII case and white space are duplicates; so are all texts without words. Texts shorter than a
    shingle are one shingle. All pairs of the similarity or more are linked. Very long texts are compared whole. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    each = materialise(described(own, shingle, similarity), "described")
    # a doc_id with several texts is a node once for each; links between nodes of one id mean nothing
    first = F.min_by(F.struct("lo", "hi", "s1", "s2", "n", "keys"), "doc_id").alias("x")
    nodes = materialise(each.groupBy("t1", "t2").agg(F.min("doc_id").alias("node"), first).select("t1", "t2", "node", "x.*"), "nodes")
    ids = materialise(each.select("doc_id", "t1", "t2"), "ids")
    forget(spark, each)
    tiled = materialise(_tiles(candidate_groups(nodes).join(nodes.select("node", "n"), "node"), 0), "tiles")
    labels = verified_classes(own, tiled, shingle, similarity)
    far = materialise(prefix_links(nodes, tiled, labels, similarity), "prefix_links")
    halves = far.select(F.xxhash64("x", "y").alias("unit"), F.explode(F.array("x", "y")).alias("tile"))
    wanted = halves.join(tiled.select("tile", "node"), "tile").select("unit", "node")
    labels = relabelled(labels, _verified(_texts(own, wanted), shingle, similarity))
    named = nodes.join(labels, "node").select("t1", "t2", F.col("held").alias("class_id"))
    return ids.join(named, ["t1", "t2"])


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each near-duplicate class, that with the smallest doc_id; columns unchanged, whatever their names.

    Rows without a doc_id stay. Of rows equal in doc_id and words one stays; a doc_id with several texts is judged as one
    document. An empty table gives an empty result.
    """
    classes = duplicate_classes(docs, shingle, similarity)
    fate = materialise(classes.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("times")), "fate")
    gone, twice = (fate.where(c).select(F.col("doc_id").alias("k")) for c in ("class_id <> doc_id", "times > 1"))
    kept = docs.join(gone, docs["doc_id"] == gone["k"], "left_anti")
    if fate.where("class_id = doc_id AND times > 1").isEmpty():
        return kept
    many = kept.join(twice, kept["doc_id"] == twice["k"], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, kept["doc_id"] == twice["k"], "left_anti").unionByName(many)
