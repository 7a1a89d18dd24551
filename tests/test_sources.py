import hashlib

import pytest
from pyspark.sql import functions as F

from lodestack.operators import inventory
from lodestack.sources import readers, sinks

KEY = bytes(range(32))
A, B, C = (hashlib.sha256(x).hexdigest() for x in (b"a", b"b", b"c"))
AWKWARD = 'dir/with "quotes" and \\ and é.txt'


@pytest.fixture
def tree(spark):
    rows = [(AWKWARD, 9, [A, B, A]), ("empty", 0, []), ("x/y z.txt", 1, [C])]
    return spark.createDataFrame(rows, "path string, bytes long, chunks array<string>")


def as_rows(df):
    return sorted(map(tuple, df.select("path", "bytes", "chunks").collect()))


def test_plain_and_sealed_manifests(spark, tree, tmp_path):
    lines = [r.value for r in sinks.manifest_lines(tree).collect()]
    (tmp_path / "SNAP_1.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "SNAP_2.jsonl.gcm").write_bytes(bytes(sinks.sealed_manifest(tree, KEY).first().content))
    (tmp_path / "other.txt").write_text("no manifest")
    plain = readers.manifests(spark, str(tmp_path))
    assert as_rows(plain) == as_rows(tree) and {r.snapshot for r in plain.collect()} == {"SNAP_1"}
    sealed = readers.encrypted_manifests(spark, str(tmp_path), KEY)
    assert as_rows(sealed) == as_rows(tree) and {r.snapshot for r in sealed.collect()} == {"SNAP_2"}
    assert [tuple(r) for r in readers.snapshot_files(spark, str(tmp_path)).collect()] == [("SNAP_1", False), ("SNAP_2", True)]
    assert "StringStartsWith" in plain.where(F.startswith("path", F.lit("x/")))._jdf.queryExecution().executedPlan().toString()


def test_control_files(spark, tmp_path):
    (tmp_path / "catalog").write_text(f"{A}\t5\nno tab\nshort\t3\n{B}\t7\n{A}\t5\n")
    assert sorted(map(tuple, readers.catalog(spark, str(tmp_path / "catalog")).collect())) == sorted([(A, 5), (A, 5), (B, 7)])
    assert readers.catalog_rows(spark, str(tmp_path / "catalog")).first().entries == 5
    (tmp_path / "stripes").write_text(f"{A}\t0\t3\n{B}\t0\t4\n{A}\t9\t1\n")
    assert [tuple(r) for r in readers.stripe_index(spark, str(tmp_path / "stripes")).orderBy("line_no").collect()] == [(A, 0, 3, 0), (B, 0, 4, 1), (A, 9, 1, 2)]
    (tmp_path / "delta").write_text(f"{A}\t0\nbad\t1\n{A}\t2\n")
    assert [tuple(r) for r in readers.index_delta(spark, str(tmp_path / "delta")).orderBy("line_no").collect()] == [(A, 0, 0), (A, 2, 2)]
    (tmp_path / "p.properties").write_text("# comment\nrs.k=10\nname = a\\:b \n\n")
    assert readers.properties(spark, str(tmp_path / "p.properties"), {"rs.r": "2", "rs.k": "8"}) == {"rs.r": "2", "rs.k": "10", "name": "a:b"}
    assert readers.number("1_048_576") == 1048576
    assert sinks.properties_text({"b": "2", "a": "1"}) == "a=1\nb=2\n"


def test_index_run(spark, tmp_path):
    run = spark.createDataFrame([(B, 255), (A, 0), (C, 7)], "chunk_id string, drive_ord int")
    data = b"".join(bytes(r.record) for r in sinks.index_records(run).collect())
    assert len(data) == 99 and data[:32] == bytes.fromhex(min(A, B, C))
    (tmp_path / "index.dat").write_bytes(data)
    assert [tuple(r) for r in readers.index_run(spark, str(tmp_path / "index.dat")).collect()] == sorted([(A, 0), (B, 255), (C, 7)])


def test_inventory_files(spark, tmp_path):
    catalog = spark.createDataFrame([(A, 1), (B, 1), (C, 2)], "chunk_id string, drive_ord int")
    m, k = inventory.sizes(catalog)
    bits = sinks.inventory_bits(inventory.build(catalog, m, k), 1, m)
    content = sinks.inventory_bytes("repo", "náme", "drive", "/mnt/x", 1_700_000_000, 2, m, k, bits)
    (tmp_path / "n__drive.inv").write_bytes(content)
    row = readers.inventories(spark, str(tmp_path)).first()
    assert (row.repo_id, row.repo_name, row.drive_id, row.label, row.n, row.m_bits, row.k, bytes(row.bits)) == ("repo", "náme", "drive", "/mnt/x", 2, m, k, bits)
    set_bits = {8 * i + j for i, b in enumerate(bits) if b for j in range(8) if b >> j & 1}
    assert set_bits == {r.position for r in inventory.positions(catalog, m, k).where("drive_ord = 1").collect()}
    with pytest.raises(ValueError):
        readers.parse_inventory(b"OTHER" + content[5:])


def test_line_manifest(spark, tmp_path):
    rows = [("a b c.txt", "F", 12, [(A, 5), (B, 7)]), (" leading", "L", 0, []), ("z", "F", 5, [(A, 5)])]
    tree = spark.createDataFrame(rows, "path string, mode string, bytes long, chunks array<struct<id:string,size:long>>")
    lines = [r.value for r in sinks.line_manifest(tree, "S1", "2025-01-01", "host", "avg=1", "rabin").collect()]
    assert lines[:3] == ["SNAPSHOT S1 2025-01-01 host", "PARAMS avg=1", "ALGO rabin"] and lines[-1] == "END"
    (tmp_path / "S1.manifest").write_text("\n".join([*lines, "FILE after the end F 1", f"CHUNK {C} 1"]) + "\n")
    got = readers.line_manifests(spark, str(tmp_path / "S1.manifest")).collect()
    assert sorted((r.path, r.mode, r.bytes, [tuple(c) for c in r.chunks]) for r in got) == sorted(rows) and {r.snapshot for r in got} == {"S1"}


def test_stored_trees(spark, tmp_path):
    for cid, suffix in ((A, ""), (B, ".chunk")):
        folder = tmp_path / "chunks" / cid[:2] / cid[2:4]
        folder.mkdir(parents=True)
        (folder / f"{cid}{suffix}").write_bytes(cid[:1].encode())
    (tmp_path / "chunks" / "stray.tmp").write_text("x")
    assert {(r.chunk_id, bytes(r.payload)) for r in readers.chunk_tree(spark, str(tmp_path / "chunks")).collect()} == {(c, c[:1].encode()) for c in (A, B)}
    stripe = tmp_path / "parity" / "stripe-00000012"
    stripe.mkdir(parents=True)
    (stripe / "p_0").write_bytes(b"zero")
    (stripe / "p_1").write_bytes(b"one")
    (stripe / "sidecar.json").write_text('{"k":3,"r":2,"shardSize":4,"chunks":["%s","","%s"],"sizes":[4,0,2]}' % (A, B))
    assert sorted((r.stripe_id, r.row, bytes(r.payload)) for r in readers.parity_shards(spark, str(tmp_path / "parity")).collect()) == [(12, 0, b"zero"), (12, 1, b"one")]
    assert tuple(readers.sidecars(spark, str(tmp_path / "parity")).first()) == (12, 3, 2, 4, [A, None, B], [4, 0, 2])
    files = readers.files(spark, str(tmp_path / "parity"))
    assert {(r.path, r.length) for r in files.select("path", "length").collect()} == {("stripe-00000012/p_0", 4), ("stripe-00000012/p_1", 3), ("stripe-00000012/sidecar.json", (stripe / "sidecar.json").stat().st_size)}
    scan = files.select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scan.split("ReadSchema")[-1].split("\n")[0]


def test_files_with_hidden_names(spark, tmp_path):
    names = ["a.txt", ".profile", "_x", "_k=1/y", ".d/e/f.txt", "p/.q", "p/r.txt", "p/_s/t", "z._COPYING_", "_metadata", "_metadata.d/u"]
    for n, name in enumerate(names):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * n)
    (tmp_path / ".link").symlink_to(tmp_path / "a.txt")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        got = readers.files(spark, root).collect()
        assert sorted((r.path, r.length, bytes(r.content)) for r in got) == sorted((name, n, b"x" * n) for n, name in enumerate(names))
    assert all(r.modificationTime is not None for r in got)
    assert {r.path for r in readers.files(spark, str(tmp_path), glob="*.txt").collect()} == {"a.txt", "p/r.txt", ".d/e/f.txt"}
    assert {r.path for r in readers.files(spark, str(tmp_path), hidden=False).collect()} == {"p/r.txt", "_k=1/y", "_metadata.d/u"}
