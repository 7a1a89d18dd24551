"""Content-defined chunking: one file to many ordered chunks.

Where a cut may fall depends on the last few bytes only, so hashes of all positions of a block are computed at once with
numpy, and a short pass over the candidates keeps to the least and largest size. One file is one unit of work, of which a
block's hashes and payloads are held at a time; payloads are cut where they lie and are never shuffled.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.scalar import sha256_hex

#: Seed and shifts of the generator of both gear tables; base and modulus of the rolling polynomial.
GEAR_SEED, GEAR_SHIFTS = 0x9E3779B97F4A7C15, (13, 7, 17)
BASE, MODULUS = 257, (1 << 61) - 1
ALGORITHMS = ("fast", "gear-high", "rabin")
#: Bytes of a file that are hashed at once, and of payloads that are handed on at once; a block holds two chunks at least.
BLOCK = 8 << 20
CHUNKED = "path string, pos int, offset long, raw_size int, chunk_id string, payload binary"


class Params(NamedTuple):
    """Sizes in bytes. fast: normalised chunking, the default; gear-high: high-bit mask; rabin: polynomial window."""

    algorithm: str = "fast"
    least: int = 256 << 10
    average: int = 1 << 20
    most: int = 4 << 20
    window: int = 64

    def checked(self) -> Params:
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {self.algorithm!r}; known: {', '.join(ALGORITHMS)}")
        if not 0 < self.least <= self.most or self.average < 2 or self.average > 1 << 30:
            raise ValueError("sizes must satisfy 0 < least <= most and 2 <= average <= 2^30")
        if self.algorithm == "gear-high" and not self.least < self.average < self.most:
            raise ValueError("gear-high needs least < average < most")
        if self.algorithm != "gear-high" and self.average & (self.average - 1):
            raise ValueError("average must be a power of two")
        return self


@cache
def gear(folded: bool) -> np.ndarray:
    """256 random words from a xorshift generator: its low halves, or both halves folded."""
    x, mask, out = GEAR_SEED, (1 << 64) - 1, []
    a, b, c = GEAR_SHIFTS
    for _ in range(256):
        x ^= x << a & mask
        x ^= x >> b
        x ^= x << c & mask
        out.append((x ^ x >> 32 if folded else x) & 0xFFFFFFFF)
    return np.array(out, np.uint32)


def gear_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each position the sum of the last 32 bytes' words, each shifted by its distance, modulo 2^32."""
    h = table[data]
    for s in (1, 2, 4, 8, 16):
        older = h[:-s].copy()
        h[s:] += older << np.uint32(s)
    return h


def _times(x: np.ndarray, c: int) -> np.ndarray:
    """x * c modulo 2^61 - 1, exactly."""
    p, u = np.uint64(MODULUS), np.uint64
    xh, xl, ch, cl = x >> u(32), x & u(0xFFFFFFFF), u(c >> 32), u(c & 0xFFFFFFFF)
    middle, low = xh * cl + xl * ch, xl * cl
    total = (xh * ch << u(3)) + (middle >> u(29)) + ((middle & u((1 << 29) - 1)) << u(32)) + (low >> u(61)) + (low & p)
    total = (total & p) + (total >> u(61))
    return np.where(total >= p, total - p, total)


def rabin_hashes(data: np.ndarray, window: int) -> np.ndarray:
    """Polynomial of every full window, by doubling; entry i is the window that starts at i."""
    if len(data) < window:
        return np.empty(0, np.uint64)
    part, size, done, taken = data.astype(np.uint64), 1, None, 0
    while taken < window:
        if window & size:
            if done is None:
                done, taken = part, size
            else:
                n = len(data) - taken - size + 1
                done = _times(done[:n], pow(BASE, size, MODULUS)) + part[taken : taken + n]
                done = np.where(done >= MODULUS, done - np.uint64(MODULUS), done)
                taken += size
        if taken < window:
            n = len(part) - size
            part = _times(part[:n], pow(BASE, size, MODULUS)) + part[size : size + n]
            part = np.where(part >= MODULUS, part - np.uint64(MODULUS), part)
            size *= 2
    return done


def _first(ends: list[int], low: int, high: int) -> int | None:
    """The first candidate end in low..high."""
    at = bisect_left(ends, low)
    return ends[at] if at < len(ends) and ends[at] <= high else None


def _early(data: np.ndarray, start: int, sizes: range, table: np.ndarray, mask: int) -> int | None:
    """Cuts so close to the start that the hash has not seen 32 bytes: the hash begins anew with each chunk."""
    h = 0
    for n, b in enumerate(data[start : start + sizes.stop - 1].tolist(), 1):
        h = (h << 1) + int(table[b]) & 0xFFFFFFFF
        if n in sizes and not h & mask:
            return start + n
    return None


def cuts(data: np.ndarray, p: Params, start: int = 0) -> list[int]:
    """Ends of the chunks from ``start`` on, where one begins, ascending; the last is the length. Empty data has none."""
    n = len(data)
    if start >= n:
        return []
    if p.algorithm == "rabin":
        zones = [(p.least, p.most, p.average - 1, (np.flatnonzero((rabin_hashes(data, p.window) & np.uint64(p.average - 1)) == 0) + p.window).tolist())]
        table = None
    else:
        table = gear(p.algorithm == "fast")
        h = gear_hashes(data, table)
        if p.algorithm == "fast":
            bits = p.average.bit_length() - 1
            strict, loose = p.average - 1, (1 << max(1, bits - 1)) - 1 if bits > 1 else p.average - 1
            spans = [(p.least + 1, min(p.average, p.most), strict), (max(p.least, p.average) + 1, p.most, loose)]
        else:
            spans = [(p.least, p.most, ~(next(1 << k for k in range(32) if 1 << k >= p.average) - 1) & 0xFFFFFFFF)]
        zones = [(a, b, m, (np.flatnonzero((h & np.uint32(m)) == 0) + 1).tolist()) for a, b, m in spans]
    out = []
    while start < n:
        end = None
        for low, high, mask, ends in zones:
            if table is not None and low < 32:
                end = _early(data, start, range(low, min(high, 31) + 1), table, mask)
                low = 32
            if end is None and low <= high:
                end = _first(ends, start + low, start + high)
            if end is not None:
                break
        start = min(n, end if end is not None else start + p.most)
        out.append(start)
    return out


def cuts_by_block(data: np.ndarray, p: Params, block: int = BLOCK) -> Iterator[int]:
    """The same ends, with hashes of one block at a time; a chunk that may go on beyond its block begins the next one."""
    start, block = 0, max(block, 2 * p.most)
    while start < len(data):
        # the rolling window looks back beyond the start of a chunk
        base, stop = max(0, start - p.window), min(len(data), start + block)
        for end in cuts(data[base:stop], p, start - base):
            if stop < len(data) and start + p.most > stop:
                break
            start = base + end
            yield start


def chunk_files(files: DataFrame, params: Params, payloads: bool = True) -> DataFrame:
    """(path, pos, offset, raw_size, chunk_id, payload) of files (path, content). Null content is an empty file."""
    p = params.checked()

    types = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.binary())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["path", "pos", "offset", "raw_size", "chunk_id", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column(0).to_pylist()):
                content = batch.column(1)[i].as_buffer()
                if content is None:
                    continue
                view, start, rows, held = memoryview(content), 0, [], 0
                for pos, end in enumerate(cuts_by_block(np.frombuffer(content, np.uint8), p)):
                    part = bytes(view[start:end])
                    rows.append((path, pos, start, end - start, hashlib.sha256(part).hexdigest(), part if payloads else None))
                    held += end - start
                    start = end
                    if held >= BLOCK:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, CHUNKED)


def chunk_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """Newline chunks, wholly in the JVM: (all other columns, pos, line, raw_size, chunk_id); empty lines are chunks."""
    others = [c for c in files.columns if c != text]
    lines = files.select(*others, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    return lines.select("*", F.octet_length("line").alias("raw_size"), sha256_hex("line").alias("chunk_id"))


def outside_bounds(chunks: DataFrame, params: Params) -> DataFrame:
    """Per file: chunks, and how many but the last break the bounds."""
    from pyspark.sql import Window

    last = F.col("pos") == F.max("pos").over(Window.partitionBy("path"))
    bad = (F.col("raw_size") > params.most) | (~last & (F.col("raw_size") < params.least))
    return chunks.withColumn("bad", bad).groupBy("path").agg(F.count("*").alias("n_chunks"), F.count_if("bad").alias("n_outside"))
