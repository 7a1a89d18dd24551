import random

import numpy as np
import pytest

from lodestack.operators import chunking
from lodestack.operators.chunking import Params

M64, M32 = (1 << 64) - 1, (1 << 32) - 1


def slow_gear_table(folded):
    x, out = 0x9E3779B97F4A7C15, []
    for _ in range(256):
        x ^= (x << 13) & M64
        x ^= x >> 7
        x ^= (x << 17) & M64
        out.append((x ^ (x >> 32) if folded else x) & M32)
    return out


def slow_cuts(data, p):
    """Byte at a time, with the hash begun anew in each chunk (but for the rolling window)."""
    out, size, h, window = [], 0, 0, []
    table = slow_gear_table(p.algorithm == "fast")
    high = ~(next(1 << k for k in range(32) if 1 << k >= p.average) - 1) & M32
    for i, b in enumerate(data):
        size += 1
        if p.algorithm == "rabin":
            window = (window + [b])[-p.window :]
            h = sum(x * pow(257, len(window) - 1 - k, (1 << 61) - 1) for k, x in enumerate(window)) % ((1 << 61) - 1)
            cut = size >= p.most or size >= p.least and len(window) == p.window and not h & (p.average - 1)
        else:
            h = (h << 1) + table[b]
            if p.algorithm == "gear-high":
                cut = size >= p.least and (not h & high or size >= p.most)
            else:
                loose = p.average // 2 - 1 if p.average > 2 else p.average - 1
                mask = p.average - 1 if size <= p.average else loose
                cut = size > p.least and not h & mask or size >= p.most
        if cut:
            out.append(i + 1)
            size = h = 0 if p.algorithm != "rabin" else size
            size = 0
    if size:
        out.append(len(data))
    return out


@pytest.mark.parametrize("p", [Params("fast", 40, 128, 512), Params("fast", 3, 16, 70), Params("fast", 64, 64, 64), Params("fast", 300, 64, 400), Params("gear-high", 20, 33, 90), Params("gear-high", 40, 1 << 25, 1 << 26), Params("gear-high", 1, 2, 50), Params("rabin", 30, 64, 300, 48), Params("rabin", 5, 16, 60, 7), Params("rabin", 30, 64, 300, 1)])
def test_cuts_match_a_byte_at_a_time(p):
    rng = random.Random(7)
    for data in (b"", b"x", rng.randbytes(31), rng.randbytes(3000), b"\0" * 1500, b"ab" * 700, rng.randbytes(500) * 4):
        assert chunking.cuts(np.frombuffer(data, np.uint8), p.checked()) == slow_cuts(data, p)


@pytest.mark.parametrize("p", [Params("fast", 40, 128, 512), Params("fast", 3, 16, 70), Params("gear-high", 20, 33, 90), Params("rabin", 30, 64, 300, 48), Params("rabin", 5, 16, 60, 90)])
def test_blocks_do_not_move_cuts(p):
    rng = random.Random(12)
    for data in (b"", rng.randbytes(31), rng.randbytes(9000), b"\0" * 3000, rng.randbytes(700) * 5):
        whole = np.frombuffer(data, np.uint8)
        for block in (1, 1000, 1999, 1 << 20):
            assert list(chunking.cuts_by_block(whole, p, block)) == chunking.cuts(whole, p)


def test_long_files_come_in_several_batches(spark, monkeypatch):
    data = random.Random(5).randbytes(300_000)
    monkeypatch.setattr(chunking, "BLOCK", 50_000)
    df = spark.createDataFrame([("a", bytearray(data))], "path string, content binary")
    found = sorted(chunking.chunk_files(df, Params("fast", 256, 1024, 4096)).collect(), key=lambda r: r.pos)
    assert b"".join(bytes(r.payload) for r in found) == data
    assert [r.pos for r in found] == list(range(len(found))) and [r.offset for r in found] == [sum(r.raw_size for r in found[:k]) for k in range(len(found))]


def test_gear_tables_differ_and_modular_product_is_exact():
    assert chunking.gear(False).tolist() == slow_gear_table(False) != slow_gear_table(True) == chunking.gear(True).tolist()
    p, rng = (1 << 61) - 1, random.Random(1)
    xs = [0, 1, p - 1, p // 2, *(rng.randrange(p) for _ in range(200))]
    for c in (0, 1, 257, p - 1, rng.randrange(p)):
        assert chunking._times(np.array(xs, np.uint64), c).tolist() == [x * c % p for x in xs]


@pytest.mark.parametrize("bad", [Params("sliding"), Params("fast", 10, 1000, 2000), Params("rabin", 0, 64, 100), Params("fast", 100, 64, 50), Params("gear-high", 100, 100, 200), Params("gear-high", 1, 1 << 31, 1 << 32)])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        bad.checked()


def test_a_shift_moves_few_boundaries(spark):
    data = random.Random(3).randbytes(60_000)
    df = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"!" + data)), ("empty", bytearray()), ("none", None)], "path string, content binary")
    for algorithm in chunking.ALGORITHMS:
        found = chunking.chunk_files(df, Params(algorithm, 256, 1024, 4096)).collect()
        by_path = {p: [r for r in found if r.path == p] for p in ("a", "b")}
        assert {r.path for r in found} == {"a", "b"}
        for p, whole in (("a", data), ("b", b"!" + data)):
            assert b"".join(bytes(r.payload) for r in by_path[p]) == whole
            assert [r.pos for r in by_path[p]] == list(range(len(by_path[p])))
        if algorithm != "gear-high":
            shared = {r.chunk_id for r in by_path["a"]} & {r.chunk_id for r in by_path["b"]}
            assert len(shared) > 0.8 * len(by_path["a"])
