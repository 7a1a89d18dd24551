from itertools import combinations

import numpy as np
import pytest

from lodestack.functions import gf256
from lodestack.operators import parity


def slow_mul(a, b):
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = a << 1 ^ (0x11D if a & 0x80 else 0)
        b >>= 1
    return out


def test_field():
    product, inverse = gf256.tables()
    assert all(product[a, b] == slow_mul(a, b) for a in range(0, 256, 5) for b in range(256))
    assert all(product[a, inverse[a]] == 1 for a in range(1, 256))
    g = gf256.generator(8, 3)
    assert g[0].tolist() == [1] * 8 and g[1].tolist() == [1, 2, 4, 8, 16, 32, 64, 128] and g[2, 2] == slow_mul(3, 3)


@pytest.mark.parametrize("k, r, losses", [(8, 1, 1), (8, 2, 1), (8, 2, 2), (10, 2, 2), (4, 3, 1)])
def test_any_losses_are_recovered(k, r, losses):
    data = np.random.default_rng(k).integers(0, 256, (k, 50), np.uint8)
    shards = gf256.encode(data, r)
    for lost in combinations(range(k), losses):
        found = gf256.recover([None if i in lost else d for i, d in enumerate(data)], list(shards))
        assert all((a == b).all() for a, b in zip(found, data, strict=True))
    # a lost parity shard keeps its row number
    if r > losses:
        found = gf256.recover([None, *data[1:]], [None, *shards[1:]])
        assert (found[0] == data[0]).all()


def test_too_many_losses_and_singular_rows_say_so():
    data = np.random.default_rng(0).integers(0, 256, (8, 9), np.uint8)
    shards = gf256.encode(data, 3)
    assert gf256.recover([None] * 4 + list(data[4:]), list(shards)) is None
    singular = 0
    for lost in combinations(range(8), 3):
        found = gf256.recover([None if i in lost else d for i, d in enumerate(data)], list(shards))
        singular += found is None
        assert found is None or all((a == b).all() for a, b in zip(found, data, strict=True))
    assert singular == 9  # the generator is not MDS for three erasures


def test_longest_and_empty_shards_and_wrong_bytes(spark):
    payloads = [b"", b"a", b"bb" * 50, b"the longest of them all" * 30, b"xyz"]
    import hashlib

    rows = [(0, i, hashlib.sha256(p).hexdigest(), bytearray(p)) for i, p in enumerate(payloads)]
    members = spark.createDataFrame(rows, "stripe_id long, slot int, chunk_id string, payload binary")
    stripes = parity.encode(members, 8, 2, ["stripe_id"])
    row = stripes.first()
    assert row.shard_size == len(payloads[3]) and row.sizes[:5] == [len(p) for p in payloads] and row.chunks[5:] == [None] * 3
    for lost in [(3,), (0, 3), (2, 4)]:
        back = parity.repair(stripes, members.where(~members.slot.isin(*lost)).select("chunk_id", "payload"))
        assert {r.chunk_id: bytes(r.payload) for r in back.collect()} == {rows[i][2]: payloads[i] for i in lost}
    assert parity.repair(stripes, members.where("slot > 2").select("chunk_id", "payload")).collect() == []
    wrong = spark.createDataFrame([(rows[2][2], bytearray(b"changed"))], "chunk_id string, payload binary").unionByName(members.where("slot NOT IN (2, 3)").select("chunk_id", "payload"))
    assert parity.repair(stripes, wrong).collect() == []


def test_pending_stripe_is_carried_over(spark):
    ids = spark.createDataFrame([(f"{i:064x}", i) for i in range(19)], "chunk_id string, seq int")
    first = parity.assign_across_files(ids.where("seq < 11"), 8, ["seq"])
    full, rest = parity.split_pending(first, 8)
    assert full.count() == 8 and rest.count() == 3
    pending = rest.select("chunk_id", rest.pos.alias("n"))
    second = parity.assign_across_files(ids.where("seq >= 11"), 8, ["seq"], parity.next_stripe(full), pending)
    got = {int(r.chunk_id, 16): (r.stripe_id, r.pos) for r in second.collect()}
    assert got == {i: (i // 8, i % 8) for i in range(8, 19)}
    assert parity.split_pending(second, 8, finalize=True)[0].count() == 11
    assert parity.next_stripe(full, 7) == 7 and parity.next_stripe(full.limit(0)) == 0
