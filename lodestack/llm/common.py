"""Plumbing shared by the operators of this subpackage: the shared scratch folder, word splitting and small guards."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the ASCII controls 9 to 13; ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
CHECKPOINT = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. Where the session names none, one is set on a single machine only."""
    found = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getConf().get(CHECKPOINT)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT} to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestack-")
        spark.conf.set(CHECKPOINT, found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestack/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def freeing_shuffles(spark: SparkSession):
    """Inside, each finished action drops its shuffle files at once: what it made has been written as Parquet."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with freeing_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files under frames made by ``materialise`` that nothing will read again."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for frame in frames:
        for folder in {name.rsplit("/", 1)[0] for name in frame.inputFiles()}:
            if "/lodestack/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def folders_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders in a folder, committed ones only; none if it does not exist."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = store.listStatus(path) if store.exists(path) else []
    return [f.getPath().getName() for f in found if f.isDirectory() and store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]


def own_columns(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """Only the named columns, so that further ones with clashing names never meet ours."""
    return df.select(*[F.col(n) for n in names], *[F.col(old).alias(new) for new, old in renamed.items()])


def packed(df: DataFrame, *names: str) -> DataFrame:
    """The whole row as ``row``, and the named columns: what is joined on or added beside them clashes with nothing."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), *[df[n] for n in names])


def texts_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of an Arrow string column; None for null."""
    return column.cast(pa.binary()).to_pylist()


class WordHashes(dict):
    """word -> 63-bit XXH64, kept while the worker runs and emptied when it grows past a bound."""

    LIMIT = 1 << 20

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) >> 1
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the finalizer of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(words: np.ndarray, n: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all runs of ``n`` words, by doubling; shorter input gives none."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    power, size, part = np.uint64(factor), 1, words
    done, taken, mask = None, 0, (1 << 64) - 1
    while True:
        if n & size:
            if done is None:
                done, taken = part, size
            else:
                done = done[: len(words) - taken - size + 1] * power + part[taken : taken + len(words) - taken - size + 1]
                taken += size
        if taken == n:
            return mix(done[: len(words) - n + 1])
        part = part[: len(part) - size] * power + part[size:]
        power = np.uint64(int(power) * int(power) & mask)
        size *= 2


def in_groups(rows: Iterable[tuple], size_of, limit: int) -> Iterator[list[tuple]]:
    """Consecutive rows, cut where the summed size passes ``limit``: bounds what is held at once."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size_of(row)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held
