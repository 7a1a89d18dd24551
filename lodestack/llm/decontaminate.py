"""Benchmark decontamination by spaced seeds.

A mask picks some of eleven consecutive tokens; its hash ignores the others, so that a changed token there does not hide
a match. Hashes of the benchmark and of the corpus are joined; around every hit the two texts are laid side by side and
the tokens counted that agree. What overlaps for 13 tokens, up to a fifth of them changed, is a leak.

Before the join a bitmap of fixed size, built from the benchmark's hashes by aggregation, drops nearly all corpus hashes
at the scan. The bitmap may fill up with a huge benchmark; then more hashes are joined, with the same result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import WordHashes, in_groups, materialise, mix, read_table

#: Fixed masks: 1 is a token that counts. Whatever two tokens of 13 change, one mask fits beside them somewhere.
MASKS = ("11101101000", "00010110111", "11010001110", "01111000101", "10001111010")
SPAN = 11
#: Tokens that must overlap (a shorter item: all of it), and the share of them that must agree.
WINDOW, AGREE = 13, 0.8
#: Fewer tokens are too short to be told from chance: such an item leaks only as the whole of a document.
MIN_TOKENS = 8
#: 2^26 bits of bitmap for all documents and as many for short ones: 16 MB, whatever the benchmark.
BITMAP = 26
CHUNK = 4 << 20


class Seed(NamedTuple):
    salt: int
    places: tuple[int, ...]
    span: int
    #: Only for documents that are no longer than the seed.
    short: bool = False


def _parts(n: int) -> list[tuple[int, ...]]:
    """n tokens in one part more than may be changed, so that one part is whole; all in one where none may be changed."""
    parts = n - math.ceil(AGREE * n) + 1 if n >= MIN_TOKENS else 1
    cuts = [n * k // parts for k in range(parts + 1)]
    return [tuple(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def seeds(lengths: set[int]) -> list[Seed]:
    """All masks; parts of items that are shorter than a window; and the like for every length of a shorter document."""
    out = [Seed(k + 1, tuple(i for i, c in enumerate(m) if c == "1"), SPAN) for k, m in enumerate(MASKS)]
    out += [Seed(100 * n + k, p, n) for n in sorted(lengths) if MIN_TOKENS <= n < WINDOW for k, p in enumerate(_parts(n))]
    return out + [Seed(100 * n + 50 + k, p, n, True) for n in range(1, WINDOW) for k, p in enumerate(_parts(n))]


def _item_kinds(kinds: list[Seed], n: int) -> list[Seed]:
    """Seeds of an item of ``n`` tokens. Short documents: those cut from it, or under eight tokens those that equal it."""
    long = [k for k in kinds if not k.short and n >= MIN_TOKENS and (k.salt < 100 if n >= WINDOW else k.span == n and k.salt >= 100)]
    return long + [k for k in kinds if k.short and (MIN_TOKENS <= k.span < n if n >= MIN_TOKENS else k.span == n)]


def seed_hashes(tokens: np.ndarray, seed: Seed) -> np.ndarray:
    """One hash for each place where the seed fits."""
    count = len(tokens) - seed.span + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.full(count, seed.salt, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for p in seed.places:
        out = out * factor + tokens[p : p + count]
    return mix(out)


def tokens_of(text: bytes, known: WordHashes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _items(benchmark: DataFrame) -> DataFrame:
    """(key, item_id, tokens) of items with any tokens; equal texts once, under their smallest id; key stands for the text."""
    unique = benchmark.where("text IS NOT NULL").groupBy("text").agg(F.min("item_id").alias("item_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            rows = [(k, i, tokens_of(t.encode(), known)) for k, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            rows = [r for r in rows if len(r[2])]
            tokens = pa.array([t.view(np.int64) for _, _, t in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in rows], pa.int64()), pa.array([i for _, i, _ in rows], pa.int64()), tokens], ["key", "item_id", "tokens"])

    return unique.select(F.xxhash64("text").alias("key"), "item_id", "text").mapInArrow(run, "key long, item_id long, tokens array<long>")


def _item_seeds(items: DataFrame, kinds: list[Seed]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, tokens in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = tokens.values.to_numpy(zero_copy_only=False).view(np.uint64)
                fit = _item_kinds(kinds, len(own))
                found = [seed_hashes(own, k) for k in fit]
                if not found:
                    continue
                h = np.concatenate(found)
                at = np.concatenate([np.arange(len(f)) for f in found])
                short = np.repeat([k.short for k in fit], [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([i] * len(h), pa.int64()), pa.array(at.astype(np.int32)), pa.array(short)], ["h", "item", "item_at", "short"])

    return items.select("key", "tokens").mapInArrow(run, "h long, item long, item_at int, short boolean")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Twice 2^BITMAP bits, the high bits of each hash set, in the second half for short documents; at most
    2^BITMAP / 16384 rows come to the driver, 4 KB each."""
    half = F.when(F.col("short"), F.lit(1 << BITMAP)).otherwise(F.lit(0))
    slot = F.shiftrightunsigned("h", 64 - BITMAP) + half + 1  # these functions count from one
    rows = hashes.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(2 << BITMAP >> 3, np.uint8)
    for r in rows:
        at = (r.bucket - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _short_hits(tokens: np.ndarray, starts: np.ndarray, kind: Seed, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of whole documents, ``kind.span`` tokens each, that the bitmap's second half has."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.concatenate([seed_hashes(tokens[a : a + kind.span], kind) for a in starts])
    slot = (h >> np.uint64(64 - BITMAP)) + np.uint64(1 << BITMAP)
    ok = (filled[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return starts[ok], h[ok]


def _hits(docs: DataFrame, kinds: list[Seed], bits: np.ndarray, reach: int) -> DataFrame:
    """(doc_id, tid, region, start, tokens, hits): stretches of a document around its hits.

    reach: how far an item can extend on either side of a hit; hits whose surroundings meet share a stretch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, filled = WordHashes(), shared.value
        for batch in batches:
            ids, tids = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows = ((ids[i], tids[i], batch.column(1)[i].as_buffer()) for i in range(batch.num_rows))
            for group in in_groups(((d, x, t.to_pybytes() if t is not None else b"") for d, x, t in rows), lambda r: len(r[2]), CHUNK):
                sizes, parts = [], []
                for _, _, text in group:
                    parts.append(tokens_of(text, known))
                    sizes.append(len(parts[-1]))
                tokens = np.concatenate(parts)
                ends = np.cumsum(sizes)
                owner = np.repeat(np.arange(len(group)), sizes)
                found = []
                for kind in kinds:
                    if kind.short:
                        firsts = np.flatnonzero(np.asarray(sizes) == kind.span)
                        found.append(_short_hits(tokens, ends[firsts] - kind.span, kind, filled))
                        continue
                    h = seed_hashes(tokens, kind)
                    slot = h >> np.uint64(64 - BITMAP)
                    ok = np.flatnonzero(filled[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                    ok = ok[ok + kind.span <= ends[owner[ok]]]
                    found.append((ok, h[ok]))
                at, h = np.concatenate([a for a, _ in found]), np.concatenate([x for _, x in found])
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order]
                who = owner[at]
                cut = np.flatnonzero((np.diff(at) > 2 * reach) | (np.diff(who) != 0)) + 1
                out = []
                for n, (i, j) in enumerate(zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(at)])), strict=True)):
                    k = who[i]
                    base = ends[k] - sizes[k]
                    a, b = max(base, at[i] - reach), min(ends[k], at[j - 1] + reach)
                    out.append((group[k][0], group[k][1], int(a - base), int(a - base), tokens[a:b].view(np.int64), [{"h": x, "at": y} for x, y in zip(h[i:j].view(np.int64).tolist(), (at[i:j] - base).tolist(), strict=True)]))
                c = list(zip(*out, strict=True))
                hit = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.list_(pa.int64())), pa.array(c[5], hit)], ["doc_id", "tid", "region", "start", "tokens", "hits"])

    return docs.select("doc_id", "text", "tid").mapInArrow(run, "doc_id long, tid long, region long, start long, tokens array<long>, hits array<struct<h:long,at:long>>")


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int, window: int = WINDOW, agree: float = AGREE) -> tuple[int, int, int] | None:
    """Lays ``item`` on ``doc`` with its first token at ``shift``: (first, length, tokens that agree) of the overlap.

    Every stretch of ``window`` tokens (or of the whole of the shorter text, if that is less) in which enough agree
    belongs to it; None if there is none. Stretches must lie within both texts. Under eight tokens both must be equal.
    """
    a, b = max(0, shift), min(len(doc), shift + len(item))
    size = min(window, len(item), len(doc))
    if b - a < size or not size:
        return None
    if size < MIN_TOKENS:
        if len(doc) != len(item):
            return None
        agree = 1.0
    same = (doc[a:b] == item[a - shift : b - shift]).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(same)))
    good = np.flatnonzero(total[size:] - total[:-size] >= agree * size)
    if not len(good):
        return None
    first, last = int(good[0]), int(good[-1]) + size
    return a + first, last - first, int(total[last] - total[first])


def _verified(pairs: DataFrame) -> DataFrame:
    """pairs (doc_id, tid, start, tokens, key, item_id, item, shift) -> the overlaps that hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.columns
            out = []
            for i in range(batch.num_rows):
                doc, item = (c[k][i].values.to_numpy(zero_copy_only=False) for k in (3, 6))
                start = c[2][i].as_py()
                if got := best_overlap(doc, item, c[7][i].as_py() - start):
                    out.append((c[0][i].as_py(), c[1][i].as_py(), c[4][i].as_py(), c[5][i].as_py(), got[0] + start, got[1], got[2], len(item)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "tid", "key", "item_id", "first_word", "n_words", "n_equal", "item_words"])

    return pairs.select("doc_id", "tid", "start", "tokens", "key", "item_id", "item", "shift").mapInArrow(run, "doc_id long, tid long, key long, item_id long, first_word long, n_words long, n_equal long, item_words long")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, tid, item_id, first_word, n_words, n_equal, item_words): the longest overlap of each document and item.

    Tokens are words after lower-casing A to Z. Null texts and those without words, on either side, overlap with nothing.
    An item of fewer than eight tokens overlaps only with a document of the same tokens; a document of 8 to 12 tokens with
    items that hold all of it, but for a fifth of its tokens. Equal items count once, under the smallest item_id; items
    without an id are looked for like others, with a row for each. Repeated rows of a document give one overlap. tid is xxhash64 of the document's text. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    items = materialise(_items(benchmark.select("item_id", "text")), "items")
    size = F.size("tokens")
    short = {r.n for r in items.where(size < WINDOW).select(size.alias("n")).distinct().collect()}
    longest = items.agg(F.max(size).alias("n")).first().n
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("tid"))
    if longest is None:
        return spark.createDataFrame([], "doc_id long, tid long, item_id long, first_word long, n_words long, n_equal long, item_words long")
    kinds = seeds(short)
    item_seeds = materialise(_item_seeds(items, kinds), "seeds")
    # no stretch of agreement is cut off: it lies within the item, which lies within reach of the hit
    regions = materialise(_hits(own, kinds, bitmap(item_seeds), longest), "regions")
    hit = regions.select("doc_id", "tid", "region", F.explode("hits").alias("x")).select("doc_id", "tid", "region", "x.h", "x.at").distinct()
    laid = hit.join(item_seeds.withColumnRenamed("h", "k"), F.col("h") == F.col("k")).select("doc_id", "tid", "region", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    text = regions.select(F.col("doc_id").alias("d"), F.col("tid").alias("t"), F.col("region").alias("r"), "start", "tokens").dropDuplicates(["d", "t", "r"])
    with_text = laid.join(text, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tid") == F.col("t")) & (F.col("region") == F.col("r")))
    with_item = with_text.join(items.select("key", "item_id", F.col("tokens").alias("words")), F.col("item") == F.col("key")).drop("item").withColumnRenamed("words", "item")
    best = F.max(F.struct("n_equal", "n_words", -F.col("first_word"), "item_words"))
    found = _verified(with_item).groupBy("doc_id", "tid", "key").agg(F.first("item_id").alias("item_id"), best.alias("x"))
    return found.select("doc_id", "tid", "item_id", (-F.col("x.col3")).alias("first_word"), "x.n_words", "x.n_equal", "x.item_words")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap with no benchmark item, columns unchanged."""
    bad = materialise(leaks(docs, benchmark).select(F.col("doc_id").alias("d"), F.col("tid").alias("t")).distinct(), "leaks")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["d"]) & (F.xxhash64(docs["text"]) == bad["t"]), "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaking documents only, a row for each item they overlap with."""
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("tid")


_TOKENS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: Every shift of every item over every document: words are joined, shifts with enough of them are looked at closely.
OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS dk, doc_id, w, len(w) AS dn FROM (SELECT DISTINCT doc_id, {_TOKENS} AS w FROM documents WHERE text IS NOT NULL)),
i AS (SELECT row_number() OVER () AS ik, item_id, w, len(w) AS n FROM (SELECT min(item_id) AS item_id, {_TOKENS} AS w FROM benchmark WHERE text IS NOT NULL GROUP BY text)),
dt AS (SELECT dk, unnest(w) AS t, unnest(range(dn)) AS p FROM d),
it AS (SELECT ik, unnest(w) AS t, unnest(range(n)) AS q FROM i),
s AS (SELECT dk, ik, p - q AS shift, count(*) AS c FROM dt JOIN it USING (t) GROUP BY ALL),
g AS (SELECT dk, ik, shift, dn, n, least({WINDOW}, n, dn) AS size, CASE WHEN least(n, dn) < {MIN_TOKENS} THEN least(n, dn) ELSE (4 * least({WINDOW}, n, dn) + 4) // 5 END AS need,
             list_transform(range(greatest(0, shift), least(dn, shift + n)), lambda p: (d.w[p + 1] = i.w[p - shift + 1])::INTEGER) AS same
      FROM s JOIN d USING (dk) JOIN i USING (ik)
      WHERE c >= CASE WHEN least(n, dn) < {MIN_TOKENS} THEN least(n, dn) ELSE (4 * least({WINDOW}, n, dn) + 4) // 5 END AND (least(n, dn) >= {MIN_TOKENS} OR n = dn)),
x AS (SELECT *, list_filter(range(0, len(same) - size + 1), lambda a: list_sum(same[a + 1 : a + size]) >= need) AS good FROM g WHERE len(same) >= size),
f AS (SELECT dk, ik, n, greatest(0, shift) + good[1] AS first_word, good[-1] + size - good[1] AS n_words, list_sum(same[good[1] + 1 : good[-1] + size]) AS n_equal FROM x WHERE len(good) > 0)
SELECT d.doc_id, i.item_id, f.first_word::BIGINT AS first_word, f.n_words::BIGINT AS n_words, f.n_equal::BIGINT AS n_equal, f.n::BIGINT AS item_words
FROM f JOIN d USING (dk) JOIN i USING (ik)
QUALIFY row_number() OVER (PARTITION BY dk, ik ORDER BY f.n_equal DESC, f.n_words DESC, f.first_word) = 1
"""
