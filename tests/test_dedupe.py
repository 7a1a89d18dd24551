import pytest
from pyspark.sql import functions as F

from lodestack.operators import dedupe, index, inventory, manifest, restore, verify


@pytest.fixture
def rows(spark):
    data = [("a", 0, "x", 4), ("a", 1, "y", 4), ("b", 0, "x", 4), ("b", 1, "z", 4), ("c", 0, "w", 4)]
    return spark.createDataFrame(data, "path string, pos int, chunk_id string, raw_size int").repartition(3)


@pytest.mark.parametrize("cap, kept", [(7, 2), (8, 2), (9, 3), (0, 1), (1000, 5)])
@pytest.mark.parametrize("blocks", [None, "path"])
def test_cap_overshoots_by_one_chunk_at_most(rows, cap, kept, blocks):
    got = dedupe.under_cap(rows, cap, ["path", "pos"], F.col("raw_size"), blocks)
    assert sorted((r.path, r.pos) for r in got.collect()) == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("c", 0)][:kept]
    assert set(got.columns) == set(rows.columns)


def test_effective_cap():
    assert dedupe.effective_cap(None, 1000, None) is None
    assert dedupe.effective_cap(500, 1000, 0.7) == 500 and dedupe.effective_cap(None, 1001, 0.7) == 700
    assert dedupe.effective_cap(500, 1000, 1.5) == 500


def test_states_and_totals(spark, rows):
    known = spark.createDataFrame([("z",), ("z",)], "chunk_id string")
    state = dedupe.with_state(rows, known, ["path", "pos"])
    assert {(r.path, r.pos): r.is_new for r in state.collect()} == {("a", 0): True, ("a", 1): True, ("b", 0): False, ("b", 1): False, ("c", 0): True}
    assert tuple(dedupe.totals(state, F.col("is_new")).first()) == (3, 5, 3, 2, 20, 12)
    assert tuple(dedupe.totals(state.limit(0), F.col("is_new")).first()) == (0, 0, 0, 0, 0, 0)


def test_codecs_are_never_sniffed(spark):
    tricky = [bytearray(b"\x1f\x8b but no gzip"), bytearray(b"CSE1 but not sealed"), bytearray()]
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate(tricky)], "chunk_id string, payload binary")
    for compress, key in ((False, None), (True, None), (False, b"k" * 32), (True, b"k" * 32)):
        back = verify.decode_payload(verify.encode_payload(df, compress, key), key)
        assert {r.chunk_id: bytes(r.payload) for r in back.collect()} == {str(i): bytes(p) for i, p in enumerate(tricky)}


def test_verification_can_stop_the_job(spark):
    import hashlib

    good = spark.createDataFrame([(hashlib.sha256(b"a").hexdigest(), bytearray(b"a"))], "chunk_id string, payload binary")
    bad = spark.createDataFrame([("0" * 64, bytearray(b"a")), ("1" * 64, None)], "chunk_id string, payload binary")
    assert [r.status for r in verify.must_hold(verify.chunk_status(good)).collect()] == ["ok"]
    assert sorted(r.status for r in verify.chunk_status(bad).collect()) == ["bad", "failed"]
    with pytest.raises(Exception, match="is bad|is failed"):
        verify.must_hold(verify.chunk_status(bad)).collect()


def test_union_by_attachment_or_by_time(spark):
    rows = [("p", 0, "S9", "new"), ("p", 1, "S1", "old"), ("p", 0, "S0", "older"), ("q", 0, "S9", "only")]
    m = spark.createDataFrame(rows, "path string, drive_ord int, snapshot string, x string")
    assert {r.path: r.x for r in manifest.union_latest(m).collect()} == {"p": "old", "q": "only"}
    assert {r.path: r.x for r in manifest.union_latest(m, by_time=True).collect()} == {"p": "new", "q": "only"}


def test_drives_are_registered_once(spark):
    none = spark.createDataFrame([], "drive_ord int, drive_id string, label string")
    one = index.register_drive(none, "a", "A")
    two = index.register_drive(one, "b", "B")
    again = index.register_drive(two, "a", "moved")
    assert sorted(map(tuple, again.collect())) == [(0, "a", "moved"), (1, "b", "B")]


def test_cover_ends_without_gain_and_missing_copies_are_named(spark):
    needed = spark.createDataFrame([("1",), ("2",), ("3",), ("9",)], "chunk_id string")
    holds = spark.createDataFrame([("1", 0), ("2", 0), ("2", 1), ("3", 1), ("1", 2)], "chunk_id string, drive_ord int")
    assert [tuple(r) for r in inventory.greedy_cover(needed, holds).orderBy("step").collect()] == [(1, 0, 2), (2, 1, 1)]
    assert inventory.greedy_cover(needed, holds.limit(0)).collect() == []
    refs = needed.selectExpr("'p' AS path", "0 AS pos", "chunk_id")
    assert sorted(r.chunk_id for r in restore.unavailable(refs, holds).collect()) == ["9"]
