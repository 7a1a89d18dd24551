"""Quality by compression: a text is good if it packs better with a Zstandard dictionary of good texts than of bad ones.

Whole texts are cut into blocks, since a dictionary helps most where little has gone before; the difference of the two
compressed sizes, summed over all blocks and divided by the bytes of the text, goes through a logistic curve.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm.common import read_table, texts_of

BLOCK = 2048
LEVEL = 3
DICT_BYTES = 64 << 10
#: Labelled rows that a model is fitted on, for each label: at most so many, and at most so many bytes of text, of which
#: no single text is more than a sixteenth. Longer texts are scored like any other, but not learned from.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 16 << 20
THRESHOLD = 0.7


class Model(NamedTuple):
    good: bytes
    bad: bytes
    slope: float
    offset: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> dict[int, tuple[list[bytes], int]]:
    """label -> (whole texts of a bounded, seeded sample, rows with that label). Held-out, unlabelled and contradictory ids do not count."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("most"))
    known = known.where((F.col("y") == F.col("most")) & ~held_out(F.col("doc_id"))).select("doc_id", "y")
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    out = {}
    for y in (0, 1):
        turn = F.xxhash64("doc_id")
        chosen = known.where(F.col("y") == y).orderBy(turn, "doc_id").limit(rows).select(F.col("doc_id").alias("__id"))
        texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select(turn.alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
        texts = texts.where(F.octet_length("text") <= size // 16).orderBy("turn", "text").limit(rows)
        upto = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy("turn", "text").rowsBetween(Window.unboundedPreceding, 0))
        out[y] = ([r.text.encode() for r in texts.withColumn("upto", upto).where(F.col("upto") <= size).orderBy("turn", "text").select("text").collect()], counts.get(y, 0))
    return out


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def _train(texts: list[bytes]) -> bytes:
    parts = [b for t in texts for b in blocks(t)]
    total = sum(map(len, parts))
    if len(parts) < 16 or total < 8192:
        return b"".join(parts)[-DICT_BYTES:]
    return zstandard.train_dictionary(min(DICT_BYTES, total // 4), parts, level=LEVEL).as_bytes()


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.good, self.bad = (self._packer(d) for d in (model.good, model.bad))

    @staticmethod
    def _packer(dictionary: bytes) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(dictionary) if len(dictionary) >= 8 else None
        if data:
            data.precompute_compress(level=LEVEL)
        options = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
        return zstandard.ZstdCompressor(dict_data=data, **options) if data else zstandard.ZstdCompressor(level=LEVEL, **options)

    def difference(self, text: bytes) -> float:
        """(bytes with the bad dictionary - bytes with the good one) / bytes."""
        parts = blocks(text)
        if not parts:
            return 0.0
        return (sum(len(self.bad.compress(p)) for p in parts) - sum(len(self.good.compress(p)) for p in parts)) / len(text)

    def score(self, text: bytes) -> float:
        z = self.model.slope * self.difference(text) + self.model.offset
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Weighted logistic regression on one feature, by damped Newton steps."""
    scale = float(np.abs(x).max()) or 1.0
    a = np.c_[x / scale, np.ones(len(x))]
    w = np.zeros(2)

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge * (w @ w) / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (weight * (p - y)) + ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    """Dictionaries from one half of the sample, the curve from the other, weighted to how common each label is.

    With only one label at hand, or none, every score is the smoothed share of good labels.
    """
    got = sample(docs, labels, rows, size)
    (bad, n_bad), (good, n_good) = got[0], got[1]
    if len(bad) < 4 or len(good) < 4:
        return Model(b"", b"", 0.0, math.log((n_good + 1) / (n_bad + 1)))
    first = Model(_train(good[::2]), _train(bad[::2]), 1.0, 0.0)
    scorer = Scorer(first)
    rest = [good[1::2], bad[1::2]]
    x = np.array([scorer.difference(t) for part in rest for t in part])
    y = np.repeat([1.0, 0.0], [len(p) for p in rest])
    weight = np.repeat([n_good / len(rest[0]), n_bad / len(rest[1])], [len(p) for p in rest])
    slope, offset = _logistic(x, y, weight * len(x) / weight.sum())
    return first._replace(slope=slope, offset=offset)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (double, 0 to 1) of the whole text; null texts count as empty, which score by the curve at zero."""
    schema = docs.select("*", F.lit(0.0).alias("score")).schema
    if "score" in docs.columns:
        raise ValueError("the table has a column score already; drop or rename it")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.score(t or b"") for t in texts_of(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of ``docs``, other columns ignored. Null ids are not held out."""
    scored = scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, columns unchanged."""
    aside = "score"
    while aside in docs.columns:
        aside += "_"
    kept = scores(docs.withColumnsRenamed({"score": aside}), model).where(F.col("score") >= threshold).drop("score")
    return kept.withColumnsRenamed({aside: "score"}) if "score" in docs.columns else kept


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. Null and empty texts score by the curve at zero; equal texts, also repeated rows, score alike; very
    long texts are scored whole; a null doc_id is not held out; an empty table gives an empty result."""
    docs = read_table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, read_table(spark, sf_dir, "labels")))
