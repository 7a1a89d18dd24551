"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm.common import WORD, materialise, packed, read_table

WEIGHTS = (1, 2, 3)
EPOCHS = 3
SEED = "mix-1"
#: Sources are broadcast up to this many rows (about 100 bytes each); beyond, they are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: The seeded order of documents is a 24-bit number, refined 8 bits at a time: a source never has more than 256 sums a level.
LEVELS, BITS = 3, 8


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_cell(doc_id: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, LEVELS * BITS // 4), 16, 10).cast("long")


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sizes (source, source_size) -> with target, whole (whole repetitions), rest (words of the fractional one).

    Sources by code point, null last, weigh ``weights`` in turn and share the total; whoever would exceed ``epochs``
    times its size is clamped there and the excess goes to the others by weight, until none is above. In the order of
    cap over weight the clamped sources come first, so one ordered pass over the sources finds the level at which that
    ends. One row per source goes through a single task here; documents never do.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    s = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("decimal(20,0)"))
    s = s.withColumn("cap", (F.col("source_size") * epochs).cast("decimal(20,0)"))
    everything = Window.partitionBy()
    lower = Window.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total, weight = F.sum("source_size").over(everything).cast("decimal(20,0)"), F.sum("w").over(everything)
    zero = F.lit(0).cast("decimal(20,0)")
    s = s.select("*", total.alias("t"), weight.alias("tw"), F.coalesce(F.sum("cap").over(lower), zero).alias("c0"), F.coalesce(F.sum("w").over(lower), zero).alias("w0"))
    s = s.withColumn("clamped", F.col("cap") * (F.col("tw") - F.col("w0")) < F.col("w") * (F.col("t") - F.col("c0")))
    for name in ("cap", "w"):
        s = s.withColumn(f"{name}_clamped", F.sum(F.when(F.col("clamped"), F.col(name)).otherwise(zero)).over(everything))
    free = F.col("w").cast("double") * (F.col("t") - F.col("cap_clamped")).cast("double") / (F.col("tw") - F.col("w_clamped")).cast("double")
    s = s.withColumn("target", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(F.least(free, F.col("cap").cast("double"))))
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(epochs).cast("long"), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0).cast("long"))
    s = s.withColumn("whole", whole)
    return s.select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))


def _small(sources: DataFrame, n: int) -> DataFrame:
    return F.broadcast(sources) if n <= BROADCAST_SOURCES else sources


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> tuple[DataFrame, DataFrame, int]:
    """(sized documents, sources with their decision, number of sources).

    A document belongs to the fractional repetition of its source if its seeded cell lies before the cell where the
    running sum of words passes ``rest``, or in that cell if more than half of the cell fits.
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), seeded_cell(F.col("doc_id"), seed).alias("cell"))
    sized = materialise(sized, "sized")
    sources = materialise(water_fill(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs), "sources")
    n = sources.count()
    cur = sources.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - level - 1)
        inside = sized.join(_small(cur, n), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("cell", shift + BITS) == F.col("prefix")))
        sums = inside.groupBy("s", "rest", "before", F.shiftright("cell", shift).alias("bin")).agg(F.sum("size").alias("words"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("s", "rest", "before").orderBy("bin"))
        passed = sums.withColumn("upto", upto).where("upto > rest")
        first = passed.groupBy("s", "rest").agg(F.min(F.struct("bin", "upto", "words")).alias("x"))
        cur = materialise(first.select("s", "rest", F.col("x.bin").alias("prefix"), (F.col("x.upto") - F.col("x.words")).alias("before"), F.col("x.words").alias("words")), "crossing")
        if level < LEVELS - 1:
            cur = cur.drop("words")
    edge = cur.select("s", F.col("prefix").alias("edge"), (F.col("before") + F.col("words") / 2 <= F.col("rest")).alias("edge_in"))
    decided = sources.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "whole", "edge", "edge_in")
    return sized, materialise(decided, "decided"), n


def _copies(cell: Column) -> Column:
    return F.col("whole") + F.coalesce((cell < F.col("edge")) | ((cell == F.col("edge")) & F.col("edge_in")), F.lit(False)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    Null texts count zero words; the null source is a source like any other, last in order. Repeated rows each count and
    decide alike. With no words at all every target is zero. An empty table gives an empty result. Other columns are
    ignored.
    """
    sized, decided, n = plan(docs, weights, epochs, seed)
    joined = sized.join(_small(decided, n), F.col("source").eqNullSafe(F.col("s")))
    copies = _copies(F.col("cell"))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, columns unchanged."""
    _, decided, n = plan(docs, weights, epochs, seed)
    joined = packed(docs, "doc_id", "source").join(_small(decided, n), F.col("source").eqNullSafe(F.col("s")))
    rows = joined.select("row", _copies(seeded_cell(F.col("doc_id"), seed)).alias("n")).where("n > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. Null and empty texts have size 0 and are taken 0 words; repeated rows each count; a null source is the
    last; very long texts count whole; an empty table gives an empty result."""
    return mix(read_table(spark, sf_dir, "documents")).drop("copies")


OP6_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')), 1, 6))::BIGINT AS cell
  FROM documents),
s0 AS (SELECT source, sum(size)::HUGEINT AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS w, source_size * {EPOCHS} AS cap FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () AS t, sum(w) OVER () AS tw,
         coalesce(sum(cap) OVER o, 0) AS c0, coalesce(sum(w) OVER o, 0) AS w0 FROM s1
       WINDOW o AS (ORDER BY cap::DOUBLE / w::DOUBLE, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, cap * (tw - w0) < w * (t - c0) AS clamped FROM s2),
s4 AS (SELECT *, sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER () AS cc, sum(CASE WHEN clamped THEN w ELSE 0 END) OVER () AS wc FROM s3),
s5 AS (SELECT source, source_size::BIGINT AS source_size,
         CASE WHEN clamped THEN cap::DOUBLE ELSE least(w::DOUBLE * (t - cc)::DOUBLE / (tw - wc)::DOUBLE, cap::DOUBLE) END AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN least({EPOCHS}, floor(target / source_size))::BIGINT ELSE 0 END AS whole FROM s5),
cum AS (SELECT source, cell, sum(size)::BIGINT AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY cell)::BIGINT AS upto FROM sized GROUP BY source, cell)
SELECT d.doc_id, d.size, s.source_size, s.target,
       d.size * (s.whole + CASE WHEN c.upto - c.words + c.words / 2.0 <= s.target - s.whole * s.source_size THEN 1 ELSE 0 END) AS taken
FROM sized d JOIN s6 s ON d.source IS NOT DISTINCT FROM s.source
JOIN cum c ON c.source IS NOT DISTINCT FROM d.source AND c.cell = d.cell
"""
