import gzip as py_gzip
import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from lodestack.functions import crypto, scalar

KEY = bytes(range(32))


def one(spark, value, expression, kind="binary"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression.alias("y")).first().y


def test_digests(spark):
    assert one(spark, bytearray(b"abc"), scalar.sha256_hex("x")) == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    for key in (b"k", KEY, b"long" * 40):
        assert one(spark, "a path/é", scalar.hmac_sha256_hex(key, "x"), "string") == hmac.new(key, "a path/é".encode(), "sha256").hexdigest()
    assert one(spark, "p", scalar.file_id("x", None, True), "string") == hashlib.sha256(b"p").hexdigest()
    assert one(spark, "p", scalar.file_id("x", KEY, False), "string") == hashlib.sha256(b"p").hexdigest()


def test_sealing(spark):
    assert len(one(spark, bytearray(b"abc"), scalar.seal("x", KEY, b""))) == 31
    sealed = one(spark, bytearray(b"abc"), scalar.seal("x", KEY))
    assert bytes(sealed[:4]) == scalar.CHUNK_MAGIC and len(sealed) == 35
    assert bytes(one(spark, sealed, scalar.unseal("x", KEY))) == b"abc"
    assert one(spark, sealed, scalar.try_unseal("x", KEY[::-1])) is None
    assert one(spark, bytearray(b"garbage that is no ciphertext at all"), scalar.try_unseal("x", KEY, b"")) is None
    with pytest.raises(Exception, match="AES"):
        one(spark, sealed, scalar.unseal("x", KEY[::-1]))


def test_gzip(spark):
    packed = one(spark, bytearray(b"abc" * 100), scalar.gzip("x"))
    assert py_gzip.decompress(bytes(packed)) == b"abc" * 100
    assert bytes(one(spark, packed, scalar.gunzip("x"))) == b"abc" * 100
    assert one(spark, bytearray(b"\x1f\x8bno"), scalar.gunzip("x")) is None
    assert one(spark, None, scalar.gzip("x")) is None


def test_wrapped_keys(spark):
    master = crypto.new_master_key()
    wrapped = crypto.wrap_key(spark, master, "open", iterations=1000)
    assert len(wrapped) == 4 + 16 + 4 + 12 + 48 and crypto.unwrap_key(spark, wrapped, "open") == master
    for bad, phrase in ((wrapped, "shut"), (wrapped[:-1] + b"\0", "open"), (b"CSKX" + wrapped[4:], "open"), (wrapped[:40], "open")):
        with pytest.raises(ValueError):
            crypto.unwrap_key(spark, bad, phrase)


def test_passphrase(monkeypatch):
    monkeypatch.delenv(crypto.PASSPHRASE, raising=False)
    with pytest.raises(ValueError):
        crypto.passphrase()
    monkeypatch.setenv(crypto.PASSPHRASE, "from outside")
    assert crypto.passphrase() == "from outside" and crypto.passphrase("given") == "given"


def slow_positions(cid, m, k):
    raw, mask = bytes.fromhex(cid), (1 << 64) - 1
    word = lambda at: int.from_bytes(raw[at : at + 8], "big")
    h1 = word(0) ^ word(16)
    h2 = word(8) ^ ((h1 << 1 | h1 >> 63) & mask)
    out = []
    for i in range(k):
        x = (h1 + i * h2) & mask
        out.append(((x ^ x >> 32) & 0x7FFFFFFF) % m)
    return out


def test_bloom_positions(spark):
    rng = random.Random(2)
    ids = [rng.randbytes(32).hex() for _ in range(50)] + ["f" * 64, "0" * 64]
    df = spark.createDataFrame([(i,) for i in ids], "chunk_id string")
    for m, k in ((1 << 20, 4), (1 << 31, 30)):
        got = {r.chunk_id: r.p for r in df.select("chunk_id", scalar.bloom_positions("chunk_id", m, k).alias("p")).collect()}
        assert got == {i: slow_positions(i, m, k) for i in ids}


def test_bloom_size():
    assert scalar.bloom_size(1000) == (1 << 20, 30) and scalar.bloom_size(1) == (1 << 20, 30)
    assert scalar.bloom_size(1_000_000) == (1 << 24, 12)
    assert [scalar.next_pow2(n) for n in (0, 1, 2, 3, 1024, 1025)] == [1, 1, 2, 4, 1024, 2048]


def test_names(spark):
    row = spark.range(1).select(
        scalar.fanout_path(F.lit("abcdef")).alias("fan"), scalar.stripe_name(F.lit(12)).alias("stripe"), scalar.parse_stripe_name(F.lit("stripe-00000012")).alias("n"), scalar.parse_stripe_name(F.lit("stripe-x")).alias("none"),
        scalar.snapshot_name(F.lit("2025-09-19 15:00:01").cast("timestamp")).alias("snap"), scalar.sanitize(F.lit("a b/ç.x")).alias("clean"), scalar.parse_number(F.lit("1_048_576")).alias("number"), scalar.slashes(F.lit("a\\b")).alias("path"),
        *[scalar.human_bytes(F.lit(n)).alias(f"h{k}") for k, n in enumerate((0, 1023, 1024, 1536, 1 << 40, 1 << 61))], scalar.file_mode(F.lit(False), F.lit(True)).alias("mode"), scalar.parse_snapshot_name(F.lit("x")).alias("bad"),
    ).first()
    assert tuple(row) == ("ab/cd/abcdef", "stripe-00000012", 12, None, "SNAP_2025-09-19T15-00-01Z", "a_b__.x", 1048576, "a/b", "0.00 B", "1023.00 B", "1.00 KiB", "1.50 KiB", "1.00 TiB", "2048.00 PiB", "D", None)
