import hashlib

from lodestack.llm import sharding

SCHEMA = "doc_id long, text string, shard string, p1 int"


def brute(rows, limit):
    """Split one bucket at a time on its next bit."""
    bits = {d: f"{int(hashlib.md5(str(d).encode()).hexdigest()[:14], 16):056b}" for d, *_ in rows}
    out, todo = {}, [("", rows)]
    while todo:
        prefix, held = todo.pop()
        size = sum(len((t or "").encode()) for _, t, *_ in held)
        if size <= limit or len(held) <= 1:
            out.update({d: (prefix, size, len(held)) for d, *_ in held})
        else:
            todo += [(prefix + b, [r for r in held if bits[r[0]][len(prefix)] == b]) for b in "01"]
    return out


def test_only_large_buckets_split(spark):
    rows = [(i, "é" * (i % 90), "old", 1) for i in range(3000)] + [(5000, "x" * 5000, "old", 1), (5001, None, "old", 1), (5002, "", "old", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for limit in (100, 2000, 10**9):
        got = {r.doc_id: (r.shard, r.shard_bytes, r.shard_docs) for r in sharding.assign(df, limit).collect()}
        assert got == brute(rows, limit)
    assert sharding.assign(df).columns == ["doc_id", "text", "p1", "shard", "shard_bytes", "shard_docs"]


def test_equal_ids_part_by_text_and_equal_rows_stay(spark):
    rows = [(7, f"text {i:04d}", "", 0) for i in range(64)] + [(None, "same row", "", 0)] * 9
    got = sharding.assign(spark.createDataFrame(rows, SCHEMA), 30).collect()
    assert len(got) == 73
    assert all(r.shard_bytes <= 30 for r in got if r.doc_id == 7)
    assert {(r.shard_bytes, r.shard_docs) for r in got if r.doc_id is None} == {(72, 9)}


def test_empty(spark):
    assert sharding.assign(spark.createDataFrame([], SCHEMA)).collect() == []
