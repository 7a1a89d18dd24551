import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import index, manifest, restore, verify
from lodestack.plans import repo as plans
from lodestack.plans.location import LocationIndex
from lodestack.plans.repo import Repo
from lodestack.streaming import ingest

KEY = bytes(range(32))
SMALL = {"least": 64, "average": 256, "most": 1024, "rs_k": 4, "rs_r": 2}


def frame(spark, files):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], "path string, content binary")


def sample(seed, n=12):
    rng = random.Random(seed)
    shared = rng.randbytes(5000)
    return {f"d{i % 3}/f{i}.bin": shared[: rng.randrange(5000)] + rng.randbytes(rng.randrange(3000)) if i else b"" for i in range(n)}


def contents(df):
    return {r.path: bytes(r.content) for r in df.collect()}


def test_backup_restore_and_increment(spark, tmp_path):
    repo = Repo.create(spark, str(tmp_path / "r"), "name", **SMALL, compress=True, encrypt=True, key=KEY)
    files = sample(1)
    one = repo.backup(frame(spark, files), "S1").first()
    assert one.files == len(files) - 1 and one.new_chunks + one.reused_chunks == one.chunks and one.bytes == sum(map(len, files.values())) > one.new_bytes
    again = repo.backup(frame(spark, files), "S2").first()
    assert again.new_chunks == 0 and again.reused_chunks == one.chunks
    changed = {**files, "d0/f3.bin": files["d0/f3.bin"] + b"more", "new": b"n" * 700}
    third = repo.backup(frame(spark, changed), "S3").first()
    assert 0 < third.new_chunks < one.new_chunks
    for name, want in (("S1", files), ("S2", files), ("S3", changed)):
        got, missing, refused = plans.restore_files([repo], name)
        assert contents(got) == want and missing.collect() == []
    got, _, _ = plans.restore_files([repo], "S3", only_prefix="d1/")
    assert contents(got) == {p: c for p, c in changed.items() if p.startswith("d1/")}
    got, _, _ = plans.restore_files([repo], "S3", only_file="new")
    assert contents(got) == {"new": b"n" * 700}
    assert [r.snapshot for r in repo.snapshots().collect()] == ["S1", "S2", "S3"]
    found = verify.summary(repo.verify()).first()
    assert found.ok == found.chunks == one.new_chunks + third.new_chunks == repo.info().first().chunks
    wrong = Repo(spark, repo.root, KEY[::-1])
    assert verify.summary(wrong.verify()).first().failed == found.chunks
    with pytest.raises(ValueError):
        Repo(spark, repo.root)
    with pytest.raises(Exception, match="(?i)exist"):
        Repo(spark, str(tmp_path / "nowhere"))
    with pytest.raises(Exception, match="(?i)exist"):
        Repo.create(spark, repo.root, "again")


def test_two_drives_missing_chunks_and_union(spark, tmp_path):
    files = sample(2)
    first = Repo.create(spark, str(tmp_path / "a"), "name", repo_id="shared", **SMALL)
    second = Repo.create(spark, str(tmp_path / "b"), "name", repo_id="shared", drive_ord=1, **SMALL)
    first.backup(frame(spark, files), "S1")
    more = {**files, "late": random.Random(9).randbytes(4000)}
    counts = second.backup(frame(spark, more), "S2", located=first.catalog).first()
    assert counts.reused_chunks > 0
    got, missing, refused = plans.restore_files([second], "S2")
    assert missing.count() > 0 and set(contents(got)) < set(more)
    got, missing, refused = plans.restore_files([second, first], "S2")
    assert contents(got) == more and missing.collect() == []
    got, _, _ = plans.restore_files([first, second])
    assert contents(got) == more
    run = first.catalog.selectExpr("chunk_id", "0 AS drive_ord").unionByName(second.catalog.selectExpr("chunk_id", "1 AS drive_ord"))
    drives = spark.createDataFrame([(0, "id0", "A"), (1, "id1", None)], "drive_ord int, drive_id string, label string")
    tree = second.manifests.where("snapshot = 'S2'")
    order, cover = plans.restore_plan(tree, index.compact(run, run.limit(0)), run.limit(0), drives)
    assert [r.drive_ord for r in order.collect()] == [0, 1] and cover.first().pct == 100.0
    f0, m, k = first.inventory()
    f1, _, _ = second.inventory()
    steps = plans.suggest(tree, f0.unionByName(f1), m, k).collect()
    assert [s.drive_ord for s in steps] == [0, 1]
    assert len(plans.suggest(tree, f0.unionByName(f1), m, k, 1).collect()) == 1


def test_cap_leaves_an_incomplete_file(spark, tmp_path):
    repo = Repo.create(spark, str(tmp_path / "r"), "name", **SMALL)
    files = {f"f{i}": random.Random(i).randbytes(3000) for i in range(5)}
    counts = repo.backup(frame(spark, files), "S1", cap=7000).first()
    assert 7000 <= counts.new_bytes < 7000 + 1024
    rows = {r.path: r for r in repo.manifests.collect()}
    assert set(rows) == {"f0", "f1", "f2"} and [rows[p].complete for p in sorted(rows)] == [True, True, False]
    assert rows["f2"].bytes < 3000
    got, missing, refused = plans.restore_files([repo, Repo(spark, repo.root)], "S1")
    assert contents(got) == {p: files[p] for p in ("f0", "f1")} and missing.collect() == []
    assert [(r.path, r.reason) for r in refused.collect()] == [("f2", "cut short by the cap")]


def test_an_encrypted_repository_holds_no_plaintext(spark, tmp_path):
    rng = random.Random(3)
    secret, name = rng.randbytes(300), rng.randbytes(12).hex()
    repo = Repo.create(spark, str(tmp_path / "r"), "name", **SMALL, encrypt=True, key=KEY)
    repo.backup(frame(spark, {name: secret, "other": rng.randbytes(2000)}), "S1")
    assert repo.add_parity(finalize=True).count() == 0
    stored = b"".join(p.read_bytes() for p in (tmp_path / "r").rglob("*") if p.is_file())
    assert secret[:40] not in stored and secret[100:140] not in stored and name.encode() not in stored
    got, missing, refused = plans.restore_files([repo], "S1")
    assert contents(got)[name] == secret and missing.collect() == refused.collect() == []
    assert {r.ok for r in repo.verify_parity().collect()} == {True}
    assert {r.ok for r in Repo(spark, repo.root, KEY[::-1]).verify_parity().collect()} == {False}
    # a chunk that is gone comes back from sealed parity
    victim = repo.catalog.first().chunk_id
    import shutil

    kept = repo.chunks.where(F.col("chunk_id") != victim)
    kept.withColumn("fan", F.substring("chunk_id", 1, 2)).write.partitionBy("fan").parquet(str(tmp_path / "kept"))
    shutil.rmtree(tmp_path / "r" / "chunks")
    shutil.move(tmp_path / "kept", tmp_path / "r" / "chunks")
    got, missing, _ = plans.restore_files([Repo(spark, repo.root, KEY)], "S1")
    assert contents(got)[name] == secret and len(contents(got)) == 2 and missing.collect() == []


def test_lost_chunks_come_back_from_parity(spark, tmp_path):
    repo = Repo.create(spark, str(tmp_path / "r"), "name", **SMALL)
    files = sample(4)
    repo.backup(frame(spark, files), "S1")
    waiting = repo.add_parity().count()
    assert waiting < 4
    assert repo.add_parity(finalize=True).count() == 0 and repo.add_parity().count() == 0
    stored = repo.payloads().select("chunk_id", "payload")
    lost = [next(c for c in s.chunks if c) for s in repo.stripes.collect()]
    from lodestack.operators import parity

    kept = stored.where(~stored.chunk_id.isin(lost))
    refs = manifest.references(repo.manifests.select("path", "chunks"))
    back = parity.repair(repo.stripes, kept, restore.unavailable(refs, kept).select("chunk_id"))
    located = restore.located(refs, kept, [back])
    assert restore.missing(located).collect() == []
    assert contents(restore.reassemble(located)) == {p: c for p, c in files.items() if c}


def test_writing_files(spark, tmp_path):
    files = {"a/b.txt": b"one", "c": b""}
    assert {(r.path, r.bytes) for r in restore.write_files(frame(spark, files), str(tmp_path)).collect()} == {("a/b.txt", 3), ("c", 0)}
    assert (tmp_path / "a/b.txt").read_bytes() == b"one"
    for bad in ("../x", "/etc/x", "a/../../x", ""):
        with pytest.raises(ValueError):
            restore.safe_path(bad)


def test_ambiguous_snapshots(spark):
    m = spark.createDataFrame([("S1a",), ("S1b",), ("S2",)], "snapshot string")
    assert manifest.find(m, "S2").first().snapshot == "S2"
    for prefix in ("S1", "S3"):
        with pytest.raises(Exception, match="matches"):
            manifest.find(m, prefix).collect()


def test_stream_of_files(spark, tmp_path):
    repo = Repo.create(spark, str(tmp_path / "r"), "name", **SMALL)
    source = tmp_path / "in"
    source.mkdir()
    (source / "one").write_bytes(b"1" * 500)
    for extra in (None, b"2" * 900):
        if extra:
            (source / "two").write_bytes(extra)
        ingest.follow(repo, ingest.incoming_files(spark, str(source)), str(tmp_path / "cp")).awaitTermination()
    assert [r.snapshot for r in repo.snapshots().collect()] == ["BATCH_000000000000", "BATCH_000000000001"]
    got = {r.path.rsplit("/", 1)[-1]: r.bytes for r in repo.manifests.collect()}
    assert got == {"one": 500, "two": 900}


def test_file_parity_repairs_what_no_drive_has(spark, tmp_path):
    files = sample(11)
    repo = Repo.create(spark, str(tmp_path / "r"), "name", **SMALL, encrypt=True, obfuscate_parity=True, key=KEY)
    repo.backup(frame(spark, files), "S1")
    repo.add_file_parity("S1")
    count = repo.file_stripes.count()
    repo.backup(frame(spark, files), "S2")
    repo.add_file_parity("S2")
    assert repo.file_stripes.count() == count > len(files)
    assert [r.ok for r in repo.verify_parity(of_files=True).select("ok").distinct().collect()] == [True]
    lost = repo.file_stripes.select(F.element_at("chunks", 1).alias("l")).distinct()
    kept = repo.chunks.join(lost, F.col("chunk_id") == F.col("l"), "left_anti")
    kept.write.parquet(str(tmp_path / "kept"))
    gone = repo.chunks.count() - kept.count()
    spark.read.parquet(str(tmp_path / "kept")).write.mode("overwrite").parquet(f"{repo.root}/chunks")
    spark.catalog.refreshByPath(repo.root)
    got, missing, refused = plans.restore_files([repo], "S1")
    assert gone > 0 and contents(got) == files and missing.collect() == refused.collect() == []
    rows = spark.read.parquet(f"{repo.root}/file_stripes")
    assert rows.where(F.substring("stripe_id", 1, 64) == F.sha2(F.lit("d1/f1.bin"), 256)).count() == 0


def test_stored_index(spark, tmp_path):
    root = str(tmp_path / "index")
    ids = [f"{i:064x}" for i in range(9)]
    rows = lambda some: spark.createDataFrame([(i,) for i in some], "chunk_id string")
    stored = LocationIndex(spark, root)
    assert stored.run.collect() == stored.delta.collect() == stored.drives.collect() == []
    assert stored.register("a", "one") == 0
    stored.add(rows(ids[:4]), 0)
    stored.compact()
    assert stored.register("b", "") == 1 and stored.register("a", "renamed") == 0
    stored.add(rows(ids[2:7]), 1)
    stored.add(rows(ids[5:8]), 0)
    again = LocationIndex(spark, root)
    want = dict(zip(ids, [0, 0, 0, 0, 1, 1, 1, 0, None], strict=True))
    assert {r.chunk_id: r.drive_ord for r in again.locate(rows(ids)).collect()} == want
    (tmp_path / "index" / "run" / "2").mkdir()
    assert again.generation == 1
    assert [r.chunk_id for r in again.compact().collect()] == ids[:8] and again.delta.collect() == []
    assert {r.chunk_id: r.drive_ord for r in again.locate(rows(ids)).collect()} == want
    assert sorted((r.drive_ord, r.label) for r in again.drives.collect()) == [(0, "renamed"), (1, "")]
