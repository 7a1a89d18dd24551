"""Exact substring deduplication over a log-structured fingerprint index.

A window is 13 consecutive words. Each window is filed under the least hash of the eight 6-word runs inside it: two equal
windows have the same one, and neighbouring windows mostly share it, so a document files under a fifth as many
fingerprints as it has windows. The index keeps, for each fingerprint, the smallest and largest document that has it, in
sorted immutable runs, in buckets, under a manifest. A batch of documents becomes a run; it is merge-joined with the runs
before it, bucket by bucket without a shuffle, which tells what fingerprints now lie in two documents; runs are compacted
when there are several.

Only windows under such fingerprints are verified: compared by a 64-bit hash of all 13 words. Within a group of texts that are
read together a window that a smaller document of the group has is decided at once, and only its first document goes on
to the shuffle; so a passage in a third of all documents arrives as one row for each group, not for each document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import WordHashes, folders_in, forget, freeing_shuffles, grams, in_groups, materialise, read_table, scratch

WIDTH, INNER = 13, 6
BATCHES = 4
#: Runs that are merged into one when there are more.
MAX_RUNS = 2
#: Bytes of text to a bucket of the index.
BUCKET_BYTES = 32 << 20
#: Bytes of text whose words are hashed at once.
CHUNK = 4 << 20


def word_hashes(text: bytes, known: WordHashes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _least_of_run(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def filed_under(words: np.ndarray) -> np.ndarray:
    """The fingerprint of every window of a document, in order."""
    if len(words) < WIDTH:
        return np.empty(0, np.uint64)
    return _least_of_run(grams(words, INNER), WIDTH - INNER + 1)


def _docs_in(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows in groups of bounded size; the text is the second column."""
    for batch in batches:
        rest = [batch.column(k) for k in range(2, batch.num_columns)]
        ids = batch.column(0).to_pylist()
        rows = ((ids[i], batch.column(1)[i].as_buffer(), *[c[i] for c in rest]) for i in range(batch.num_rows))
        yield from in_groups(((d, t.to_pybytes() if t is not None else b"", *more) for d, t, *more in rows), lambda r: len(r[1]), CHUNK)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(fp, doc_id), each pair once for a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for group in _docs_in(batches):
            found = [(d, np.unique(filed_under(word_hashes(t, known)))) for d, t in group]
            fps = np.concatenate([f for _, f in found])
            ids = np.repeat(np.array([d for d, _ in found], np.int64), [len(f) for _, f in found])
            yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array(ids)], ["fp", "doc_id"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "fp long, doc_id long")


class FingerprintIndex:
    """Sorted immutable runs (fp, lo, hi) in a folder of the shared store. ``append`` adds a batch and says what must be verified.

    Every run is a table in ``buckets`` buckets of fp, one sorted file each, and so is a batch; joins of a batch with runs,
    and of runs with one another, need no shuffle. A manifest names the runs; whoever opens the folder again goes on where
    the last committed manifest left off, in another session too. The number of buckets is fixed when the folder is made.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 8, max_runs: int = MAX_RUNS):
        self.spark, self.max_runs, self.folder = spark, max_runs, folder or scratch(spark, "index")
        self.buckets, self.turn, self.compactions, paths = buckets, 0, 0, []
        known = sorted(x for x in folders_in(spark, self.folder) if x.startswith("manifest-"))
        if known:
            row = spark.read.schema("buckets int, runs array<string>").json(f"{self.folder}/{known[-1]}").first()
            self.buckets, paths, self.turn = row.buckets, row.runs, int(known[-1][9:]) + 1
        self.runs: dict[str, DataFrame] = {path: self._open(path, "fp BIGINT, lo BIGINT, hi BIGINT") for path in paths}

    def _open(self, path: str, columns: str) -> DataFrame:
        name = f"lodestack_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame, name: str) -> tuple[str, DataFrame]:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:12]}"
        table = f"lodestack_{uuid.uuid4().hex}"
        with freeing_shuffles(self.spark):
            rows.write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", path).saveAsTable(table)
        return path, self.spark.table(table)

    def _commit(self) -> None:
        row = self.spark.createDataFrame([(self.buckets, list(self.runs))], "buckets int, runs array<string>")
        row.coalesce(1).write.json(f"{self.folder}/manifest-{self.turn:08d}")
        self.turn += 1

    def _with_history(self, rows: DataFrame) -> DataFrame:
        """rows with old_lo and old_hi, the least and greatest document that any run has under fp; null if none has."""
        los, his = [], []
        for k, run in enumerate(self.runs.values()):
            rows = rows.join(run.select(F.col("fp").alias(f"k{k}"), F.col("lo").alias(f"lo{k}"), F.col("hi").alias(f"hi{k}")), F.col("fp") == F.col(f"k{k}"), "left")
            los, his = [*los, f"lo{k}"], [*his, f"hi{k}"]
        null = F.lit(None).cast("long")  # twice, since these functions take two columns at least
        return rows.select("fp", "lo", "hi", F.least(null, null, *los).alias("old_lo"), F.greatest(null, null, *his).alias("old_hi"))

    def append(self, docs: DataFrame) -> DataFrame:
        """(doc_id, fp) of documents, new or old, whose windows under fp may occur in another document."""
        _, rows = self._write(fingerprints(docs).repartition(self.buckets, "fp"), "batch")
        path, run = self._write(rows.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "run")
        met = self._with_history(run).where("lo < hi OR lo <> old_lo OR lo <> old_hi")
        _, met = self._write(met.select("fp", "old_lo", "old_hi"), "met")
        # a fingerprint that one old document had alone: that document is a source now
        late = met.where("old_lo = old_hi").select(F.col("old_lo").alias("doc_id"), "fp")
        hits = rows.join(met.select(F.col("fp").alias("k")), F.col("fp") == F.col("k")).select("doc_id", "fp")
        hits = materialise(hits.unionByName(late), "hits")
        forget(self.spark, rows, met)
        self.runs[path] = run
        if len(self.runs) > self.max_runs:
            self.compact()
        self._commit()
        return hits

    def compact(self) -> None:
        """All runs become one, merged bucket by bucket; the old ones go when the manifest names the new one."""
        (_, merged), *others = self.runs.items()
        for _, run in others:
            new = run.select(F.col("fp").alias("k"), F.col("lo").alias("l"), F.col("hi").alias("h"))
            merged = merged.join(new, F.col("fp") == F.col("k"), "full").select(F.coalesce("fp", "k").alias("fp"), F.least("lo", "l").alias("lo"), F.greatest("hi", "h").alias("hi"))
        old, (path, run) = list(self.runs.values()), self._write(merged, "run")
        self.runs, self.compactions = {path: run}, self.compactions + 1
        self._commit()
        forget(self.spark, *old)


def _runs(under: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where, in ``at``, a stretch of neighbouring windows under one fingerprint begins."""
    fps = under[at]
    return np.concatenate(([True], (np.diff(at) != 1) | (fps[1:] != fps[:-1])))


def _lists(offsets: np.ndarray, values: np.ndarray, kind: type = np.int32) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(kind)))


def _later(fp: np.ndarray, w: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries have a window that an entry with a smaller document has too."""
    order = np.lexsort((doc, w, fp))
    fp, w, doc = fp[order], w[order], doc[order]
    new = np.concatenate(([True], (fp[1:] != fp[:-1]) | (w[1:] != w[:-1])))
    first = np.maximum.accumulate(np.where(new, np.arange(len(fp)), 0))
    out = np.empty(len(fp), bool)
    out[order] = doc > doc[first]
    return out


WINDOWS = "fp long, doc_id long, tid long, at array<int>, w array<long>"


def _windows(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Windows to compare: (fp, doc_id, tid, at, w), a row for each stretch of windows under one fingerprint.

    at: where they start; w: a 64-bit hash of all words of each, which with the fingerprint tells windows apart. Rows with a
    null fp need no comparing: a smaller document of the same group of texts has those windows.
    """
    wanted = hits.groupBy("doc_id").agg(F.collect_set("fp").alias("fps"))
    joined = docs.where("doc_id IS NOT NULL").select("doc_id", "text", "tid").join(wanted, "doc_id").select("doc_id", "text", "tid", "fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for group in _docs_in(batches):
            parts = []
            for d, text, tid, fps in group:
                words = word_hashes(text, known)
                under = filed_under(words)
                at = np.flatnonzero(np.isin(under, fps.values.to_numpy(zero_copy_only=False).view(np.uint64)))
                if len(at):
                    w = grams(words, WIDTH)[at].view(np.int64)
                    parts.append((under[at], w, np.full(len(at), d, np.int64), np.full(len(at), tid.as_py(), np.int64), at, _runs(under, at)))
            if parts:
                fp, w, doc, tid, at, begins = (np.concatenate(c) for c in zip(*parts, strict=True))
                settled = _later(fp, w, doc)
                # settled windows: a row for each document; the others by stretches
                for part in (settled, ~settled):
                    if part.any():
                        new = np.concatenate(([True], np.diff(np.cumsum(begins)[part]) != 0)) if part is not settled else np.concatenate(([True], (np.diff(doc[part]) != 0) | (np.diff(tid[part]) != 0)))
                        starts = np.flatnonzero(new)
                        ends = np.concatenate((starts, [int(part.sum())]))
                        keys = pa.array(fp[part][starts].view(np.int64)) if part is not settled else pa.nulls(len(starts), pa.int64())
                        yield pa.RecordBatch.from_arrays([keys, pa.array(doc[part][starts]), pa.array(tid[part][starts]), _lists(ends, at[part]), _lists(ends, w[part], np.int64) if part is not settled else pa.nulls(len(starts), pa.list_(pa.int64()))], ["fp", "doc_id", "tid", "at", "w"])

    return joined.mapInArrow(run, WINDOWS)


def _compared(windows: DataFrame) -> DataFrame:
    """(doc_id, tid, at) of windows that a smaller document has, from rows that are dealt by fingerprint and sorted by it and doc_id.

    Rows stream; of a fingerprint that goes on, each different window is carried along once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = [np.empty(0, np.int64)] * 3
        for batch in batches:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            at, w = lists.flatten().to_numpy(), batch.column(4).flatten().to_numpy()
            fp, doc, tid = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            n = len(carried[0])
            all_fp, all_w, all_doc = (np.concatenate(x) for x in zip(carried, (fp[row], w, doc[row]), strict=True))
            later = _later(all_fp, all_w, all_doc)
            last = np.flatnonzero((all_fp == fp[-1]) & ~later) if batch.num_rows else np.empty(0, np.int64)
            _, once = np.unique(all_w[last], return_index=True)
            carried = [x[last[once]] for x in (all_fp, all_w, all_doc)] if batch.num_rows else carried
            hit = np.flatnonzero(later[n:])
            if len(hit):
                r = row[hit]
                starts = np.flatnonzero(np.concatenate(([True], np.diff(r) != 0)))
                yield pa.RecordBatch.from_arrays([pa.array(doc[r[starts]]), pa.array(tid[r[starts]]), _lists(np.concatenate((starts, [len(hit)])), at[hit])], ["doc_id", "tid", "at"])

    return windows.repartition("fp").sortWithinPartitions("fp", "doc_id").mapInArrow(run, "doc_id long, tid long, at array<int>")


def repeated_windows(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, tid, starts): where windows start in a text that also start in a document with a smaller doc_id."""
    windows = materialise(_windows(docs, hits), "windows")
    both = _compared(windows.where("fp IS NOT NULL")).unionByName(windows.where("fp IS NULL").select("doc_id", "tid", "at"))
    out = materialise(both.groupBy("doc_id", "tid").agg(F.flatten(F.collect_list("at")).alias("starts")), "repeated")
    forget(docs.sparkSession, windows)
    return out


def _covered(n: int, starts: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at one of ``starts``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + WIDTH, -1)
    return np.cumsum(step[:n]) > 0


def deduplicated(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without the words that repeated windows cover, joined by one space."""
    joined = docs.select("doc_id", "text", "tid").join(repeated.select(F.col("doc_id").alias("d"), F.col("tid").alias("t"), "starts"), (F.col("doc_id") == F.col("d")) & (F.col("tid") == F.col("t")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _docs_in(batches):
            rows = []
            for d, text, starts in group:
                words = text.split()
                n, removed = len(words), 0
                if starts.is_valid and len(starts.values):
                    gone = _covered(n, np.unique(starts.values.to_numpy(zero_copy_only=False)).astype(np.int64))
                    removed = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append((d, n, removed, b" ".join(words)))
            ids, n, removed, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.select("doc_id", "text", "starts").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, batches: int = BATCHES, max_runs: int = MAX_RUNS) -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row of ``docs``, which is indexed in ``batches`` ranges of doc_id.

    Null and empty texts have no words; texts of fewer than 13 words no windows. Windows of one doc_id, also over
    several rows, do not count against each other. Rows with a null doc_id are kept whole and are nobody's source. The
    result does not depend on the number of batches. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("tid"))
    ends = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("size")).first()
    index, hits = FingerprintIndex(spark, buckets=max(8, -(-ends.size // BUCKET_BYTES)), max_runs=max_runs), None
    if ends.lo is not None:
        span = ends.hi - ends.lo + 1
        cuts = [ends.lo + span * k // batches for k in range(batches + 1)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                new = index.append(own.where(F.col("doc_id").between(a, b - 1)))
                hits = new if hits is None else hits.unionByName(new)
    if hits is None:
        hits = spark.createDataFrame([], "doc_id long, fp long")
    return deduplicated(own, repeated_windows(own, hits))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. Null and empty texts: no words, nothing removed, the digest of nothing; repeated rows do not count
    against each other; a null doc_id is kept whole; very long texts are taken whole; an empty table gives an empty result."""
    found = remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
word AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM w),
win AS (SELECT doc_id, i, array_to_string(l[i:i + 12], ' ') AS s FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 11, 1))) AS i FROM w)),
least AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
hit AS (SELECT win.doc_id, win.i FROM win JOIN least USING (s) WHERE least.d < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(0, 13)) AS k FROM hit)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(l)::BIGINT AS n_words, len(l)::BIGINT - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
