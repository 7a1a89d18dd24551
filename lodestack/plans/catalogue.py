"""Registered queries and the SQL they are checked against.

Queries named ``*_roundtrip`` return what comes out of an operator and its inverse; the SQL gives the input directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack import schemas
from lodestack.functions import scalar
from lodestack.operators import chunking, dedupe, index, inventory, manifest, parity, restore, verify
from lodestack.plans import fixtures as fx
from lodestack.plans.fixtures import K, R
from lodestack.plans.location import LocationIndex
from lodestack.plans.repo import Repo, restore_files
from lodestack.session import shared
from lodestack.sources import readers, sinks

KEY = bytes(range(32))
M_BITS, HASHES = 1 << 20, 4
CAP = 200_000
SIZES = {"fast": chunking.Params("fast", 256, 1024, 4096), "gear-high": chunking.Params("gear-high", 256, 1024, 4096), "rabin": chunking.Params("rabin", 256, 1024, 4096, 48)}

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: SQL of the stand-ins of ``fixtures``, as common table expressions.
_WITH = """WITH k AS (SELECT doc_id, path, (generate_subscripts(l, 1) - 1)::INTEGER AS pos, unnest(l) AS line FROM
  (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, string_split(text, chr(10)) AS l FROM documents)),
c AS (SELECT doc_id, path, pos, strlen(line)::INTEGER AS raw_size, sha256(line) AS chunk_id FROM k),
f AS (SELECT *, (doc_id % 4)::INTEGER AS drive_ord FROM c QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id, pos) = 1),
cat AS (SELECT DISTINCT chunk_id, (doc_id % 4)::INTEGER AS drive_ord FROM c),
run AS (SELECT chunk_id, drive_ord FROM f WHERE doc_id % 2 = 0),
delta AS (SELECT chunk_id, drive_ord FROM f WHERE doc_id % 2 = 1 UNION ALL SELECT chunk_id, (drive_ord + 1) % 4 FROM f WHERE doc_id % 10 = 0),
v AS (SELECT 'conv/' || conv_id AS path, (turn % 4)::INTEGER AS drive_ord, 'SNAP_2025-01-' || lpad((turn + 1)::VARCHAR, 2, '0') || 'T00-00-00Z' AS snapshot, sha256(text) AS chunk_id FROM conversations),
st AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) - 1 AS n FROM f)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = _WITH + sql
        return f

    return add


# ---- scans and chunkers


@query("SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, strlen(text) AS length, sha256(text) AS sha256 FROM documents")
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.files(spark, sf_dir).select("doc_id", "path", F.octet_length("content").cast("long").alias("length"), scalar.sha256_hex("content").alias("sha256"))


@query("SELECT doc_id, pos, raw_size, chunk_id FROM c")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.ids(spark, sf_dir).select("doc_id", "pos", "raw_size", "chunk_id")


_RT = "SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, sha256(text) AS sha256, strlen(text)::BIGINT AS length FROM documents WHERE strlen(text) > 0"


def _round_trip(spark: SparkSession, sf_dir: str, algorithm: str) -> DataFrame:
    found = chunking.chunk_files(fx.files(spark, sf_dir), SIZES[algorithm])
    back = restore.reassemble(found)
    return back.select("path", scalar.sha256_hex("content").alias("sha256"), F.octet_length("content").cast("long").alias("length"))


@query(_RT)
def cdc_fast_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "fast")


@query(_RT)
def cdc_gear_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "gear-high")


@query(_RT)
def cdc_rabin_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "rabin")


@query("SELECT a.algorithm, source || '/' || lang || '/' || doc_id || '.txt' AS path, 0::BIGINT AS n_outside FROM documents, (VALUES ('fast'), ('gear-high'), ('rabin')) a(algorithm) WHERE strlen(text) > 0")
def cdc_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, params in SIZES.items():
        found = chunking.outside_bounds(chunking.chunk_files(fx.files(spark, sf_dir), params, payloads=False), params)
        found = found.select(F.lit(name).alias("algorithm"), "path", "n_outside")
        out = found if out is None else out.unionByName(found)
    return out


# ---- deduplication


@query("SELECT chunk_id, doc_id, pos, raw_size FROM f")
def dedupe_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.first(spark, sf_dir).select("chunk_id", "doc_id", "pos", "raw_size")


_KNOWN = "SELECT chunk_id FROM c WHERE doc_id % 10 < 3"


def _incoming(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = fx.ids(spark, sf_dir)
    return c.where("doc_id % 10 >= 3"), c.where("doc_id % 10 < 3")


@query(f"SELECT DISTINCT chunk_id FROM c WHERE doc_id % 10 >= 3 AND chunk_id NOT IN ({_KNOWN})")
def dedupe_vs_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.new_chunks(*_incoming(spark, sf_dir)).select("chunk_id").distinct()


@query("SELECT doc_id, pos, chunk_id FROM c WHERE doc_id % 4 <> 0 AND chunk_id NOT IN (SELECT chunk_id FROM cat WHERE drive_ord = 0)")
def dedupe_vs_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.ids(spark, sf_dir)
    return dedupe.new_chunks(c.where("doc_id % 4 <> 0"), c.where("doc_id % 4 = 0")).select("doc_id", "pos", "chunk_id")


@query(f"SELECT doc_id, pos, chunk_id FROM c WHERE doc_id % 10 >= 3 AND chunk_id IN ({_KNOWN})")
def reused_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.reused_chunks(*_incoming(spark, sf_dir)).select("doc_id", "pos", "chunk_id")


@query("""SELECT count(DISTINCT c.doc_id) AS files, count(*) AS chunks, count(f.chunk_id) AS new_chunks, count(*) - count(f.chunk_id) AS reused_chunks,
  sum(c.raw_size)::BIGINT AS bytes, sum(f.raw_size)::BIGINT AS new_bytes FROM c LEFT JOIN f ON f.doc_id = c.doc_id AND f.pos = c.pos""")
def dedupe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a backup of all documents would write, from ids alone: no row meets another but in two aggregates."""
    by_id = fx.ids(spark, sf_dir).groupBy("chunk_id").agg(F.count("*").alias("n"), F.sum("raw_size").alias("b"), F.max("raw_size").alias("size"))
    files = fx.table(spark, sf_dir, "documents").agg(F.countDistinct("doc_id").alias("files"))
    sums = by_id.agg(F.sum("n").alias("chunks"), F.count("*").alias("new_chunks"), (F.sum("n") - F.count("*")).alias("reused_chunks"), F.sum("b").alias("bytes"), F.sum("size").cast("long").alias("new_bytes"))
    return files.join(sums)


@query(f"""SELECT doc_id, pos, chunk_id FROM (SELECT doc_id, pos, chunk_id, coalesce(sum(raw_size) OVER (ORDER BY doc_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f) WHERE before < {CAP}""")
def write_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.under_cap(fx.first(spark, sf_dir), CAP, ["doc_id", "pos"], F.col("raw_size"), blocks="doc_id").select("doc_id", "pos", "chunk_id")


# ---- manifests and snapshots


_MANIFEST = "SELECT path, sum(raw_size)::BIGINT AS bytes, string_agg(chunk_id, ',' ORDER BY pos) AS chunks FROM c"


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.build(fx.ids(spark, sf_dir))


def _shown(m: DataFrame) -> DataFrame:
    return m.select("path", "bytes", F.array_join("chunks", ",").alias("chunks"))


@query(_MANIFEST + " GROUP BY path")
def manifest_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_manifest(spark, sf_dir))


@query(_MANIFEST + " WHERE path = 'src7/en/7.txt' GROUP BY path")
def manifest_only_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(manifest.selected(_manifest(spark, sf_dir), only_file="src7/en/7.txt"))


@query(_MANIFEST + " WHERE starts_with(path, 'src1/') GROUP BY path")
def manifest_only_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(manifest.selected(_manifest(spark, sf_dir), only_prefix="src1/"))


@query("SELECT path, pos, chunk_id FROM c")
def manifest_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.references(_manifest(spark, sf_dir))


@query("SELECT DISTINCT snapshot FROM v")
def snapshot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.snapshots(fx.versions(spark, sf_dir))


@query("SELECT drive_ord, max(snapshot) AS snapshot FROM v GROUP BY drive_ord")
def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.latest(fx.versions(spark, sf_dir))


@query("SELECT DISTINCT snapshot FROM v WHERE starts_with(snapshot, 'SNAP_2025-01-02')")
def snapshot_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.find(fx.versions(spark, sf_dir), "SNAP_2025-01-02")


@query("""SELECT snapshot, min(drive_ord) AS drive_rank, bool_or(encrypted AND drive_ord = least_drive) AS encrypted FROM (
  SELECT DISTINCT snapshot, drive_ord, e.encrypted, min(drive_ord) OVER (PARTITION BY snapshot) AS least_drive FROM v, (VALUES (true), (false)) e(encrypted)) GROUP BY snapshot""")
def snapshot_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.versions(spark, sf_dir).select("snapshot", F.col("drive_ord").alias("drive_rank")).distinct()
    return manifest.preferred(v.withColumn("encrypted", F.explode(F.array(F.lit(True), F.lit(False)))))


@query("""SELECT path, drive_ord, snapshot, chunk_id FROM v WHERE (drive_ord, snapshot) IN (SELECT (drive_ord, max(snapshot)) FROM v GROUP BY drive_ord)
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY drive_ord DESC) = 1""")
def union_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.union_latest(fx.versions(spark, sf_dir))


# ---- restore


@query("SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, sha256(replace(text, chr(10), '')) AS sha256 FROM documents")
def restore_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.chunks(spark, sf_dir)
    stored = dedupe.first_occurrences(c.select("chunk_id", "doc_id", "pos", F.col("line").cast("binary").alias("payload")), ["doc_id", "pos"])
    refs = manifest.references(manifest.build(c.drop("line")))
    files = restore.reassemble(restore.located(refs, stored))
    return files.select("path", scalar.sha256_hex("content").alias("sha256"))


@query("SELECT chunk_id, count(*) AS \"references\" FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM cat WHERE drive_ord <> 2) GROUP BY chunk_id")
def restore_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = fx.ids(spark, sf_dir).select("path", "pos", "chunk_id")
    attached = fx.catalog(spark, sf_dir).where("drive_ord <> 2").select("chunk_id", F.lit(bytearray(b"x")).alias("payload")).distinct()
    return restore.missing(restore.located(refs, attached))


@query("SELECT path, pos, coalesce(sum(raw_size) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM c")
def restore_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.offsets(fx.ids(spark, sf_dir)).select("path", "pos", "offset")


# ---- location index and plans


@query("SELECT chunk_id, min(drive_ord) AS drive_rank FROM cat GROUP BY chunk_id")
def locate_first_drive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.first_attached(fx.catalog(spark, sf_dir).withColumnRenamed("drive_ord", "drive_rank"))


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All references, with an index that does not know the documents of the last drive."""
    f = fx.first(spark, sf_dir).where("drive_ord < 3").select("chunk_id", "drive_ord")
    return index.locate(fx.ids(spark, sf_dir).select("path", "pos", "chunk_id"), f, f.limit(0))


_LOC = "SELECT c.chunk_id, f.drive_ord FROM c LEFT JOIN f ON f.chunk_id = c.chunk_id AND f.drive_ord < 3"


@query(f"SELECT drive_ord, count(*) AS refs, count(DISTINCT chunk_id) AS chunks FROM ({_LOC}) GROUP BY drive_ord")
def plan_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.tally(_located(spark, sf_dir))


@query(f"""SELECT drive_ord, count(*) AS refs, count(DISTINCT chunk_id) AS chunks, 'drive-' || drive_ord AS drive_id, CASE WHEN drive_ord < 3 THEN '/mnt/drive' || drive_ord ELSE '' END AS label
  FROM ({_LOC}) WHERE drive_ord IS NOT NULL GROUP BY drive_ord ORDER BY refs DESC, drive_ord LIMIT 2""")
def plan_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.plan(_located(spark, sf_dir), fx.drives(spark), 2)


@query(f"SELECT count(*) AS needed, count(drive_ord) AS covered, count(*) - count(drive_ord) AS unknown, round(100.0 * count(drive_ord) / count(*), 2)::DOUBLE AS pct FROM ({_LOC})")
def plan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.coverage(_located(spark, sf_dir))


_STEP = "SELECT drive_ord, count(*) AS covers FROM cat WHERE {} GROUP BY drive_ord ORDER BY covers DESC, drive_ord LIMIT 1"
_TAKEN = "chunk_id NOT IN (SELECT chunk_id FROM cat WHERE drive_ord IN ({}))"


@query(f""", s1 AS ({_STEP.format("true")}), s2 AS ({_STEP.format(_TAKEN.format("SELECT drive_ord FROM s1"))}),
s3 AS ({_STEP.format(_TAKEN.format("SELECT drive_ord FROM s1 UNION ALL SELECT drive_ord FROM s2"))})
SELECT 1 AS step, * FROM s1 UNION ALL SELECT 2, * FROM s2 UNION ALL SELECT 3, * FROM s3""")
def greedy_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.catalog(spark, sf_dir)
    return inventory.greedy_cover(c.select("chunk_id"), c, 3)


@query("SELECT chunk_id, drive_ord FROM run UNION ALL SELECT chunk_id, min(drive_ord) FROM delta WHERE chunk_id NOT IN (SELECT chunk_id FROM run) GROUP BY chunk_id")
def index_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.compact(*fx.run_and_delta(spark, sf_dir))


@query("""SELECT c.doc_id, c.pos, coalesce(r.drive_ord, d.drive_ord) AS drive_ord FROM c LEFT JOIN run r USING (chunk_id)
  LEFT JOIN (SELECT chunk_id, min(drive_ord) AS drive_ord FROM delta GROUP BY chunk_id) d USING (chunk_id)""")
def index_delta_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, delta = fx.run_and_delta(spark, sf_dir)
    one = delta.groupBy("chunk_id").agg(F.min("drive_ord").alias("drive_ord"))
    return index.locate(fx.ids(spark, sf_dir).select("doc_id", "pos", "chunk_id"), run, one).drop("chunk_id")


@query("SELECT chunk_id, arg_max(drive_ord, n) AS drive_ord FROM (SELECT chunk_id, (doc_id % 4)::INTEGER AS drive_ord, doc_id * 100000 + pos AS n FROM c) GROUP BY chunk_id")
def index_delta_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.ids(spark, sf_dir).select("chunk_id", (F.col("doc_id") % 4).cast("int").alias("drive_ord"), (F.col("doc_id") * 100000 + F.col("pos")).alias("line_no"))
    return index.last_of_delta(rows)


@query("SELECT chunk_id, 3 AS drive_ord FROM cat WHERE drive_ord = 3 AND chunk_id NOT IN (SELECT chunk_id FROM run UNION ALL SELECT chunk_id FROM delta WHERE drive_ord < 3)")
def index_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, delta = fx.run_and_delta(spark, sf_dir)
    return index.add(run, delta.where("drive_ord < 3"), fx.catalog(spark, sf_dir).where("drive_ord = 3"), 3)


@query("SELECT coalesce(max(drive_ord), -1)::BIGINT + 1 AS next FROM cat")
def next_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.next_ordinal(fx.catalog(spark, sf_dir))


@query("SELECT * FROM (VALUES (0, 'drive-0', '/mnt/drive0'), (1, 'drive-1', '/mnt/drive1'), (2, 'drive-2', '/mnt/drive2'), (3, 'drive-3', NULL), (4, 'drive-new', '/mnt/new')) d(drive_ord, drive_id, label)")
def register_drive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.register_drive(fx.drives(spark), "drive-new", "/mnt/new")


# ---- Bloom filters

_BLOOM = f""", h AS (SELECT chunk_id, drive_ord, list_transform(range(6), lambda i: ('0x' || substr(chunk_id, 1 + 8 * i, 8))::BIGINT) AS w FROM cat),
h1 AS (SELECT chunk_id, drive_ord, w, xor(w[1], w[5]) AS ah, xor(w[2], w[6]) AS al FROM h),
h2 AS (SELECT chunk_id, drive_ord, ah, al, xor(w[3], ((ah << 1) & 4294967295) | (al >> 31)) AS bh, xor(w[4], ((al << 1) & 4294967295) | (ah >> 31)) AS bl FROM h1),
x AS (SELECT chunk_id, drive_ord, i.i, al + bl * i.i AS lo, ah + bh * i.i + ((al + bl * i.i) >> 32) AS hi FROM h2, (SELECT unnest(range({HASHES})) AS i) i),
p AS (SELECT chunk_id, drive_ord, i, (xor(lo, hi) & 2147483647) % {M_BITS} AS position FROM x)
"""


@query(_BLOOM + "SELECT DISTINCT chunk_id, i::INTEGER AS i, position FROM p")
def bloom_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = fx.ids(spark, sf_dir).select("chunk_id").distinct()
    return ids.select("chunk_id", F.posexplode(scalar.bloom_positions("chunk_id", M_BITS, HASHES)).alias("i", "position"))


@query(_BLOOM + "SELECT DISTINCT drive_ord, position FROM p")
def bloom_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.positions(fx.catalog(spark, sf_dir), M_BITS, HASHES)


@query("SELECT drive_ord, chunk_id FROM cat")
def bloom_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No false negatives: what a drive has is found in its filter (false hits on others are joined away)."""
    c = fx.catalog(spark, sf_dir)
    found = inventory.probe(c.select("chunk_id"), inventory.build(c, M_BITS, HASHES), M_BITS, HASHES)
    return found.join(c, ["drive_ord", "chunk_id"], "left_semi")


@query(_BLOOM + """, bits AS (SELECT DISTINCT drive_ord AS d, position FROM p), ids AS (SELECT DISTINCT chunk_id, i, position FROM p)
SELECT d AS drive_ord, count(*) AS chunks FROM (SELECT chunk_id, d FROM ids JOIN bits USING (position) GROUP BY chunk_id, d HAVING count(*) = """ + f"{HASHES}) GROUP BY d")
def bloom_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.catalog(spark, sf_dir)
    return inventory.probe(c.select("chunk_id"), inventory.build(c, M_BITS, HASHES), M_BITS, HASHES).groupBy("drive_ord").agg(F.count("*").alias("chunks"))


# ---- stripes and parity


@query(f"SELECT path, pos, floor(pos / {K})::BIGINT AS stripe, (pos % {K})::INTEGER AS slot FROM c")
def stripe_assign_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.assign_in_file(fx.ids(spark, sf_dir), K).select("path", "pos", "stripe", "slot")


@query(f"SELECT chunk_id, n // {K} AS stripe_id, (n % {K})::INTEGER AS pos FROM st")
def stripe_assign_xfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.first(spark, sf_dir).select("chunk_id", "doc_id", F.col("pos").alias("at"))
    return parity.assign_across_files(rows, K, ["doc_id", "at"]).select("chunk_id", "stripe_id", "pos")


def _stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stripes as a plain window: (chunk_id, stripe_id, slot, raw_size, drive_ord, doc_id, at)."""
    rows = fx.first(spark, sf_dir).withColumnRenamed("pos", "at")
    return parity.numbered(rows, ["doc_id", "at"]).withColumns({"stripe_id": F.floor(F.col("n") / K).cast("long"), "slot": (F.col("n") % K).cast("int")})


@query(f"SELECT n // {K} AS stripe_id, bool_and(chunk_id IN (SELECT chunk_id FROM cat WHERE drive_ord < 2)) AS complete FROM st GROUP BY 1")
def stripe_all_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.all_local(_stripes(spark, sf_dir), fx.catalog(spark, sf_dir).where("drive_ord < 2"), ["stripe_id"])


@query(f"SELECT n // {K} AS stripe_id, max(raw_size) AS shard_size, count(*) AS members FROM st GROUP BY 1")
def stripe_shard_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.shard_sizes(_stripes(spark, sf_dir), ["stripe_id"])


@query(f"SELECT chunk_id, stripe_id FROM (SELECT chunk_id, n // {K} AS stripe_id, count(*) OVER (PARTITION BY n // {K}) AS members FROM st) WHERE members < {K}")
def stripe_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.split_pending(_stripes(spark, sf_dir), K)[1].select("chunk_id", "stripe_id")


def _with_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dedupe.first_occurrences(fx.chunks(spark, sf_dir).select("chunk_id", "doc_id", "pos", F.col("line").cast("binary").alias("payload")), ["doc_id", "pos"])
    return _stripes(spark, sf_dir).join(lines.select(F.col("chunk_id").alias("c"), "payload"), F.col("chunk_id") == F.col("c")).select("stripe_id", "slot", "chunk_id", "payload", "raw_size")


@query(f"""SELECT stripe_id, place, bit_xor(('0x' || substr(h, 2 * place::BIGINT + 1, 2))::INTEGER) AS value FROM (
  SELECT s.n // {K} AS stripe_id, hex(encode(k.line)) AS h, unnest(range(strlen(k.line))) AS place FROM st s JOIN k ON k.doc_id = s.doc_id AND k.pos = s.pos) GROUP BY 1, 2""")
def parity_xor_row0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 0 of every stripe with all its members, byte by byte."""
    made = parity.encode(_with_payload(spark, sf_dir), K, R, ["stripe_id"]).select("stripe_id", F.col("parity")[0].alias("p"))
    byte = F.conv(F.hex(F.expr("substring(p, cast(place AS int) + 1, 1)")), 16, 10).cast("int")
    return made.where(F.length("p") > 0).select("stripe_id", "p", F.explode(F.sequence(F.lit(0).cast("long"), F.length("p") - F.lit(1).cast("long"))).alias("place")).select("stripe_id", "place", byte.alias("value"))


def _recovered(spark: SparkSession, sf_dir: str, lost: str) -> DataFrame:
    members = _with_payload(spark, sf_dir)
    stripes = parity.encode(members, K, R, ["stripe_id"])
    back = parity.repair(stripes, members.where(f"NOT ({lost})").select("chunk_id", "payload"))
    return back.select("chunk_id", F.octet_length("payload").alias("raw_size"))


@query(f"SELECT chunk_id, raw_size FROM st WHERE n % {K} = (n // {K}) % {K}")
def rs_recover_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recovered(spark, sf_dir, f"slot = stripe_id % {K}")


@query(f"SELECT chunk_id, raw_size FROM st WHERE n % {K} IN ((n // {K}) % {K}, (n // {K} + 3) % {K})")
def rs_recover_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recovered(spark, sf_dir, f"slot IN (stripe_id % {K}, (stripe_id + 3) % {K})")


@query(f"SELECT c.chunk_id, min(n // {K}) AS stripe_id, min(n % {K})::INTEGER AS pos FROM (SELECT DISTINCT chunk_id FROM c) c JOIN st USING (chunk_id) GROUP BY 1")
def xfile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _stripes(spark, sf_dir).select("chunk_id", "stripe_id", F.col("slot").alias("pos"), F.lit(0).alias("drive_rank"), F.col("n").alias("line_no"))
    return parity.lookup(fx.ids(spark, sf_dir), entries)


@query(f"SELECT DISTINCT chunk_id FROM cat WHERE drive_ord < 2 AND chunk_id NOT IN (SELECT chunk_id FROM st WHERE n // {K} < 100)")
def sweep_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.catalog(spark, sf_dir)
    return parity.sweep_backlog(c, c.where("drive_ord < 2"), _stripes(spark, sf_dir).where("stripe_id < 100").select("chunk_id"))


# ---- payload codecs and scalar functions

_LINES = "SELECT DISTINCT chunk_id, raw_size FROM c"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.first_occurrences(fx.chunks(spark, sf_dir).select("chunk_id", "doc_id", "pos", F.col("line").cast("binary").alias("payload")), ["doc_id", "pos"]).select("chunk_id", "payload")


def _codec(spark: SparkSession, sf_dir: str, compress: bool, key: bytes | None) -> DataFrame:
    back = verify.decode_payload(verify.encode_payload(_lines(spark, sf_dir), compress, key), key)
    return back.select(scalar.sha256_hex("payload").alias("chunk_id"), F.octet_length("payload").alias("raw_size"))


@query(_LINES)
def aes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codec(spark, sf_dir, False, KEY)


@query(_LINES)
def gzip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codec(spark, sf_dir, True, None)


@query(_LINES)
def gzip_aes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codec(spark, sf_dir, True, KEY)


def _pad(byte: int) -> str:
    return "".join(f"\\x{b ^ byte:02X}" for b in KEY.ljust(64, b"\0"))


@query(f"SELECT path, sha256(path) AS plain_id, sha256('{_pad(0x5C)}'::BLOB || unhex(sha256('{_pad(0x36)}'::BLOB || encode(path)))) AS file_id FROM (SELECT DISTINCT path FROM c)")
def hmac_file_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.files(spark, sf_dir).select("path")
    return p.select("path", scalar.file_id("path").alias("plain_id"), scalar.file_id("path", KEY, True).alias("file_id"))


@query("SELECT DISTINCT chunk_id, substr(chunk_id, 1, 2) || '/' || substr(chunk_id, 3, 2) || '/' || chunk_id AS path FROM c")
def fanout_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.ids(spark, sf_dir).select("chunk_id", scalar.fanout_path("chunk_id").alias("path")).distinct()


@query("SELECT doc_id, 'stripe-' || lpad(doc_id::VARCHAR, 8, '0') AS name, doc_id AS parsed FROM documents")
def stripe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").select("doc_id", scalar.stripe_name("doc_id").alias("name"))
    return d.withColumn("parsed", scalar.parse_stripe_name("name"))


@query("SELECT event_id, strftime(ts, 'SNAP_%Y-%m-%dT%H-%M-%SZ') AS snapshot, epoch(date_trunc('second', ts))::BIGINT AS seconds FROM events")
def snapshot_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events").select("event_id", scalar.snapshot_name("ts").alias("snapshot"))
    return e.withColumn("seconds", F.unix_timestamp(scalar.parse_snapshot_name("snapshot")))


@query("""SELECT doc_id, CASE WHEN n < 1024 THEN format('{:.2f} B', n::DOUBLE) WHEN n < 1048576 THEN format('{:.2f} KiB', n / 1024.0)
  WHEN n < 1073741824 THEN format('{:.2f} MiB', n / 1048576.0) ELSE format('{:.2f} GiB', n / 1073741824.0) END AS size
  FROM (SELECT doc_id, n_chars * n_chars AS n FROM documents)""")
def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", scalar.human_bytes(F.col("n_chars") * F.col("n_chars")).alias("size"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS name FROM pages")
def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "pages").select("page_id", scalar.sanitize("url").alias("name"))


@query("SELECT doc_id, n_chars AS n FROM documents")
def parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace(F.col("n_chars").cast("string"), r"(\d)(?=(\d{3})+$)", "$1_")
    return fx.table(spark, sf_dir, "documents").select("doc_id", scalar.parse_number(text).alias("n"))


# ---- stored formats: written to the shared folder and read back


@query("SELECT chunk_id, raw_size::BIGINT AS stored_size FROM c")
def catalog_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared(spark, "catalog")
    sinks.catalog_lines(fx.ids(spark, sf_dir).withColumnRenamed("raw_size", "stored_size")).write.text(folder)
    return readers.catalog(spark, folder)


@query("SELECT count(*) AS entries FROM c")
def catalog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared(spark, "catalog")
    sinks.catalog_lines(fx.ids(spark, sf_dir).withColumnRenamed("raw_size", "stored_size")).write.text(folder)
    return readers.catalog_rows(spark, folder)


@query(f"SELECT chunk_id, n // {K} AS stripe_id, (n % {K})::INTEGER AS pos FROM st")
def stripe_index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared(spark, "stripe-index")
    sinks.stripe_index_lines(stripe_assign_xfile(spark, sf_dir)).write.text(folder)
    return readers.stripe_index(spark, folder).drop("line_no")


@query("SELECT chunk_id, drive_ord FROM delta")
def index_delta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared(spark, "delta")
    sinks.index_delta_lines(fx.run_and_delta(spark, sf_dir)[1]).write.text(folder)
    return readers.index_delta(spark, folder).drop("line_no")


_TREE = "SELECT path, sum(raw_size)::BIGINT AS bytes, sha256(string_agg(chunk_id, ',' ORDER BY pos)) AS chunks_sha256, 'S1' AS snapshot FROM c GROUP BY path"


def _digested(tree: DataFrame) -> DataFrame:
    return tree.select("path", "bytes", F.sha2(F.array_join("chunks", ","), 256).alias("chunks_sha256"), "snapshot")


@query(_TREE)
def manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared(spark, "manifests")
    sinks.text_file(sinks.manifest_lines(manifest.build(fx.ids(spark, sf_dir))), f"{folder}/S1.jsonl")
    return _digested(readers.manifests(spark, folder))


@query(_TREE)
def manifest_sealed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows sealed one by one, as an encrypted repository keeps them."""
    folder = shared(spark, "sealed")
    line = F.to_json(F.struct("path", "bytes", "chunks"))
    sinks.write_manifest(manifest.build(fx.ids(spark, sf_dir)).select(scalar.seal(line, KEY, scalar.MANIFEST_MAGIC).alias("content")), folder, "S1")
    opened = F.from_json(scalar.unseal("content", KEY, scalar.MANIFEST_MAGIC).cast("string"), schemas.MANIFEST)
    return _digested(spark.read.schema("content binary, snapshot string").parquet(folder).select(opened.alias("x"), "snapshot").select("x.*", "snapshot"))


@query("SELECT path, 'F' AS mode, sum(raw_size)::BIGINT AS bytes, sha256(string_agg(chunk_id || ':' || raw_size, ',' ORDER BY pos)) AS chunks_sha256, 'S1' AS snapshot FROM c GROUP BY path")
def line_manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared(spark, "lines")
    ids = fx.ids(spark, sf_dir)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("chunk_id").alias("id"), F.col("raw_size").cast("long").alias("size")))), lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size")))
    tree = ids.groupBy("path").agg(F.lit("F").alias("mode"), F.sum("raw_size").cast("long").alias("bytes"), ordered.alias("chunks"))
    sinks.text_file(sinks.line_manifest(tree, "S1", "2025-01-01", "host", "k=8", "lines"), f"{folder}/S1.manifest")
    text = F.array_join(F.transform("chunks", lambda c: F.concat_ws(":", c["id"], c["size"].cast("string"))), ",")
    return readers.line_manifests(spark, folder).select("path", "mode", "bytes", F.sha2(text, 256).alias("chunks_sha256"), "snapshot")


def _repo(spark: SparkSession, sf_dir: str, **params) -> tuple:
    p = SIZES["fast"]
    repo = Repo.create(spark, shared(spark, "repo"), "documents", least=p.least, average=p.average, most=p.most, rs_k=K, rs_r=R, **params)
    return repo, fx.files(spark, sf_dir).select("path", "content")


@query("SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, sha256(text) AS sha256 FROM documents")
def repo_backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """init, backup, and restore of the latest snapshot."""
    repo, files = _repo(spark, sf_dir, compress=True)
    repo.backup(files, "S1")
    return restore_files([repo])[0].select("path", F.sha2("content", 256).alias("sha256"))


@query("SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, sha256(text) AS sha256 FROM documents WHERE strlen(text) > 0")
def parity_sealed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An encrypted repository that has lost one chunk of each stripe: sealed parity gives them back."""
    repo, files = _repo(spark, sf_dir, encrypt=True, key=KEY)
    repo.backup(files, "S1")
    repo.add_parity(finalize=True)
    lost = repo.stripes.select(F.element_at(F.filter("chunks", lambda c: c.isNotNull()), -1).alias("chunk_id"))
    kept = repo.payloads().select("chunk_id", "payload").join(lost.select(F.col("chunk_id").alias("l")), F.col("chunk_id") == F.col("l"), "left_anti")
    refs = manifest.references(repo.manifests.select("path", "chunks"))
    located = restore.located(refs, kept, [parity.repair(repo.stripes, kept, lost)])
    return restore.reassemble(located).select("path", F.sha2("content", 256).alias("sha256"))


@query("SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, sha256(text) AS sha256 FROM documents WHERE strlen(text) > 0")
def file_parity_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunk of every per-file stripe is lost, where no other slot shares it (so no stripe loses more than R);
    parity within the file gives it back."""
    repo, files = _repo(spark, sf_dir, encrypt=True, obfuscate_parity=True, key=KEY)
    repo.backup(files, "S1")
    repo.add_file_parity("S1")
    slots = repo.file_stripes.select(F.posexplode("chunks").alias("slot", "chunk_id")).where("chunk_id IS NOT NULL")
    lost = slots.groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("slot").alias("slot")).where("n = 1 AND slot = 0").select("chunk_id")
    kept = repo.payloads().select("chunk_id", "payload").join(lost.select(F.col("chunk_id").alias("l")), F.col("chunk_id") == F.col("l"), "left_anti")
    refs = manifest.references(repo.manifests.select("path", "chunks"))
    found = parity.repair(repo.file_stripes, kept, lost).dropDuplicates(["chunk_id"])
    return restore.reassemble(restore.located(refs, kept, [found])).select("path", F.sha2("content", 256).alias("sha256"))


@query("SELECT chunk_id, drive_ord FROM f")
def index_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index: each drive's chunks are added, two compactions between, and what all drives hold is read back."""
    stored = LocationIndex(spark, shared(spark, "index"))
    chunks = fx.first(spark, sf_dir)
    for ordinal in range(fx.DRIVES):
        stored.add(chunks.where(F.col("drive_ord") == ordinal), stored.register(f"drive-{ordinal}", ""))
        if ordinal % 2:
            stored.compact()
    return stored.locate(chunks.select("chunk_id"))


@query("SELECT 0::BIGINT AS wrong, 0::BIGINT AS unaccounted, 1::BIGINT AS refused")
def restore_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backup under a cap cuts one file short: it is refused, and every other file of the snapshot is what it was."""
    repo, files = _repo(spark, sf_dir)
    repo.backup(files, "S1", cap=CAP)
    made, _, refused = restore_files([repo], "S1")
    were = files.select(F.col("path").alias("p"), F.sha2("content", 256).alias("was"))
    seen = repo.manifests.select("path").join(refused.select(F.col("path").alias("r")), F.col("path") == F.col("r"), "left")
    seen = seen.join(made.select(F.col("path").alias("m"), F.sha2("content", 256).alias("now")), F.col("path") == F.col("m"), "left").join(were, F.col("path") == F.col("p"))
    return seen.agg(F.count_if(F.col("now") != F.col("was")).alias("wrong"), F.count_if(F.col("m").isNull() & F.col("r").isNull()).alias("unaccounted"), F.count("r").alias("refused"))


# ---- verification


@query("SELECT count(*) AS chunks, count(*) - count(*) FILTER (doc_id % 97 = 0) AS ok, count(*) FILTER (doc_id % 97 = 0) AS bad, 0::BIGINT AS failed, (sum(raw_size) + count(*) FILTER (doc_id % 97 = 0))::BIGINT AS bytes FROM c")
def verify_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every 97th document have a byte too many."""
    c = fx.chunks(spark, sf_dir)
    stored = F.when(F.col("doc_id") % 97 == 0, F.concat("line", F.lit("x"))).otherwise(F.col("line")).cast("binary")
    return verify.summary(verify.chunk_status(c.select("chunk_id", stored.alias("payload"))))


@query("SELECT chunk_id, sha256(line || 'x') AS actual_id FROM k JOIN c USING (doc_id, path, pos) WHERE doc_id % 97 = 0")
def verify_relocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.chunks(spark, sf_dir)
    stored = F.when(F.col("doc_id") % 97 == 0, F.concat("line", F.lit("x"))).otherwise(F.col("line")).cast("binary")
    return verify.relocations(verify.chunk_status(c.select("chunk_id", stored.alias("payload"))))


@query(f"SELECT r.r::INTEGER AS row, count(*) AS stripes, count(*) FILTER (NOT (r.r = 1 AND s % 50 = 0)) AS ok FROM (SELECT DISTINCT n // {K} AS s FROM st), (SELECT unnest(range({R})) AS r) r GROUP BY r.r")
def verify_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard 1 of every 50th stripe is damaged."""
    from lodestack.session import cut

    members = cut(_with_payload(spark, sf_dir))
    stripes = parity.encode(members, K, R, ["stripe_id"])
    damaged = F.when(F.col("stripe_id") % 50 == 0, F.transform("parity", lambda p, i: F.when(i == 1, F.concat(p, F.lit(bytearray(b"!")))).otherwise(p))).otherwise(F.col("parity"))
    found = parity.unreadable(stripes.withColumn("parity", damaged), members)
    return found.groupBy("row").agg(F.count("*").alias("stripes"), F.count_if("ok").alias("ok"))

