"""Shards by extendible hashing. DataFrame functions only.

The directory is indexed by the leading bits of a hash; a bucket that is too large is split on one more bit, others are
left alone. Bytes are summed per cell eight bits below the buckets in question, and all splits that those eight bits
allow are decided on the sums; only buckets that are still too large go on to the next eight bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import materialise, packed, read_table

LIMIT = 16 << 20
#: Bytes of a shard in the registered query: small enough that the least of the tables is split, and its SQL shows it.
QUERY_LIMIT = 256 << 10
STEP = 8
#: Cells of a directory are broadcast up to this many (about 60 bytes each); beyond, texts are shuffled to them.
BROADCAST_CELLS = 200_000
#: Bits of one hash word; after those of doc_id, as many of the text tell rows with equal ids apart.
WORD_BITS = 56


def _hash_words() -> tuple[Column, Column]:
    by_id = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, WORD_BITS // 4), 16, 10).cast("long")
    by_text = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 64 - WORD_BITS)
    return by_id, by_text


def _prefix(depth: int) -> list[Column]:
    """The first ``depth`` bits as two numbers."""
    first = F.shiftright("__h1", max(0, WORD_BITS - depth))
    second = F.shiftright("__h2", 2 * WORD_BITS - depth) if depth > WORD_BITS else F.lit(0).cast("long")
    return [first, second]


def directory(keyed: DataFrame, limit: int = LIMIT) -> list[tuple[int, DataFrame]]:
    """keyed (__h1, __h2, __bytes) -> [(depth of the cells, cells)].

    Cells (p1, p2) tell which shard what lies under them belongs to: depth, s1, s2, shard_bytes, shard_docs; depth is
    null for cells that the next entry of the list splits further.
    """
    found: list[tuple[int, DataFrame]] = []
    inside, at = keyed, 0
    while True:
        below = at + STEP
        p1, p2 = _prefix(below)
        sums = inside.groupBy(p1.alias("p1"), p2.alias("p2")).agg(F.sum("__bytes").alias("bytes"), F.count("*").alias("docs"))
        sums = materialise(sums, "cells")
        first = below <= WORD_BITS

        def cut(depth: int, first: bool = first, below: int = below) -> list[Column]:
            if first:
                return [F.shiftright("p1", below - depth), F.lit(0).cast("long")]
            return [F.col("p1"), F.shiftright("p2", below - depth)]

        levels = F.array(*[F.struct(F.lit(d).alias("depth"), cut(d)[0].alias("s1"), cut(d)[1].alias("s2")) for d in range(at, below + 1)])
        spread = sums.select("p1", "p2", "bytes", "docs", F.explode(levels).alias("x")).select("p1", "p2", "bytes", "docs", "x.*")
        buckets = spread.groupBy("depth", "s1", "s2").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        last = below >= 2 * WORD_BITS
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") <= 1)
        if last:
            fits = fits | (F.col("depth") == below)
        leaf = spread.drop("bytes", "docs").join(buckets.where(fits), ["depth", "s1", "s2"])
        leaf = leaf.groupBy("p1", "p2").agg(F.min(F.struct("depth", "s1", "s2", "shard_bytes", "shard_docs")).alias("x"))
        cells = materialise(sums.join(leaf, ["p1", "p2"], "left").select("p1", "p2", "x.*"), "directory")
        found.append((below, cells))
        open_cells = cells.where("depth IS NULL").select("p1", "p2")
        if last or open_cells.isEmpty():
            return found
        q1, q2 = _prefix(below)
        inside = inside.join(open_cells, (q1 == F.col("p1")) & (q2 == F.col("p2")), "left_semi")
        at = below


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``docs`` with shard (the bits of its bucket), shard_bytes and shard_docs.

    Bytes are those of the UTF-8 text, null counting none. Every shard keeps within ``limit``, but for a document that is
    larger by itself (a shard of its own) and for rows equal in doc_id and text, which no hash can part. All in one
    bucket: the empty string. An empty table gives an empty result. Columns of these names are replaced.
    """
    h1, h2 = _hash_words()
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    keyed = materialise(docs.select(h1.alias("__h1"), h2.alias("__h2"), size.alias("__bytes")), "keyed")
    kept = docs.drop("shard", "shard_bytes", "shard_docs")
    rest = packed(kept, "doc_id", "text").select("row", h1.alias("__h1"), h2.alias("__h2"))
    done = []
    steps = directory(keyed, limit)
    for n, (depth, cells) in enumerate(steps):
        renamed = cells.select(*[F.col(c).alias(f"__{c}") for c in cells.columns])
        if cells.count() <= BROADCAST_CELLS:
            renamed = F.broadcast(renamed)
        q1, q2 = _prefix(depth)
        joined = rest.join(renamed, (q1 == F.col("__p1")) & (q2 == F.col("__p2")))
        bits = F.when(F.col("__depth") > WORD_BITS, F.concat(F.lpad(F.bin("__s1"), WORD_BITS, "0"), F.lpad(F.bin("__s2"), F.col("__depth") - WORD_BITS, F.lit("0")))).otherwise(F.lpad(F.bin("__s1"), F.col("__depth"), F.lit("0")))
        done.append(joined.where("__depth IS NOT NULL").select("row.*", bits.alias("shard"), F.col("__shard_bytes").alias("shard_bytes"), F.col("__shard_docs").alias("shard_docs")))
        if n + 1 < len(steps):
            rest = joined.where("__depth IS NULL").select("row", "__h1", "__h2")
    return reduce(DataFrame.unionByName, done)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. Null and empty texts count no bytes; equal doc_ids with equal texts share a shard; a text above the
    limit is a shard of its own; an empty table gives an empty result."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return assign(docs, QUERY_LIMIT).select("doc_id", size.alias("n_bytes"), "shard", "shard_bytes", "shard_docs")


OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, {WORD_BITS // 4}))::BIGINT AS h FROM documents),
x AS (SELECT doc_id, n_bytes, h, depth, h >> ({WORD_BITS} - depth) AS p FROM d, (SELECT unnest(range(0, 33))::INTEGER AS depth)),
b AS (SELECT depth, p, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM x GROUP BY depth, p),
leaf AS (SELECT x.doc_id, x.h, min(x.depth) AS depth FROM x JOIN b USING (depth, p) WHERE b.shard_bytes <= {QUERY_LIMIT} OR b.shard_docs = 1 GROUP BY x.doc_id, x.h)
SELECT d.doc_id, d.n_bytes, CASE WHEN l.depth = 0 THEN '' ELSE lpad(bin(b.p), l.depth, '0') END AS shard, b.shard_bytes, b.shard_docs
FROM d JOIN leaf l USING (doc_id, h) JOIN b ON b.depth = l.depth AND b.p = d.h >> ({WORD_BITS} - l.depth)
"""
