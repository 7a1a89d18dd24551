import random

import numpy as np
import pytest

from lodestack.llm import common, substrings

SCHEMA = "doc_id long, text string, tid string, fp int"


def brute(rows, width=13):
    split = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    least = {}
    for d, w in split:
        if d is not None:
            for i in range(len(w) - width + 1):
                key = tuple(w[i : i + width])
                least[key] = min(d, least.get(key, d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and least[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def sample(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for i in range(150):
        words = rng.choices(vocabulary, k=rng.choice([0, 3, 12, 13, 14, 60, 400]))
        for _ in range(rng.randrange(3)):
            a = rng.randrange(50)
            words[len(words) // 2 : len(words) // 2] = passage[a : a + rng.choice([12, 13, 14, 30])]
        if i % 9 == 0 and rows:
            words = (rng.choice(rows)[1] or "").split()
        rows.append((i * 37 % 1000, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(2000, None), (2001, ""), (2002, "the " * 3000), (2003, "the " * 20), (None, rows[20][1]), (None, "the " * 30), rows[5], rows[5], (rows[6][0], " ".join(passage)), (2004, " ".join(passage * 3))]
    return [(*r, "x", 1) for r in rows]


@pytest.mark.parametrize("batches, max_runs", [(1, 2), (3, 1)])
def test_against_brute_force(spark, batches, max_runs):
    rows = sample(batches)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = substrings.remove_repeats(df, batches, max_runs)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_groups_that_go_on_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        test_against_brute_force(spark, 2, 2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_window_has_its_fingerprint_whatever_surrounds_it():
    rng = np.random.default_rng(4)
    window = rng.integers(0, 1 << 63, 13, np.uint64)
    for before in (0, 1, 7, 40):
        words = np.concatenate((rng.integers(0, 1 << 63, before, np.uint64), window, rng.integers(0, 1 << 63, 9, np.uint64)))
        assert substrings.filed_under(words)[before] == substrings.filed_under(window)[0]
        assert common.grams(words, 13)[before] == common.grams(window, 13)[0]


@pytest.mark.parametrize("n", [1, 2, 5, 6, 8, 13])
def test_grams_tell_order_and_count(n):
    words = np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found = common.grams(words, n)
    assert len(found) == 39 - n + 1 == len(set(found.tolist()))
    assert common.grams(words[5 : 5 + n], n)[0] == found[5]
    assert len(common.grams(words[: n - 1], n)) == 0


def test_index_goes_on_in_another_session(spark, tmp_path):
    rows = [r for r in sample(8) if r[0] is not None]
    folder = f"file://{tmp_path}/lodestack/index"
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "xxhash64(text) AS tid")
    hits = []
    for turn in range(4):
        session = spark.newSession()
        index = substrings.FingerprintIndex(session, folder, max_runs=2)
        assert len(index.runs) == (0, 1, 2, 1)[turn]
        part = spark.createDataFrame([r for r in rows if r[0] % 4 == turn], SCHEMA)
        hits.append(index.append(session.createDataFrame(part.toPandas(), SCHEMA)))
        assert index.compactions == (turn == 2)
    both = [tuple(r) for h in hits for r in h.collect()]
    hits = spark.createDataFrame(both, "doc_id long, fp long")
    got = substrings.deduplicated(df, substrings.repeated_windows(df, hits))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_runs_are_joined_without_a_shuffle(spark):
    index = substrings.FingerprintIndex(spark, max_runs=3)
    for k in range(3):
        index.append(spark.createDataFrame([(10 * k + i, f"w{i} " * 40, "", 0) for i in range(5)], SCHEMA))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = index._with_history(next(iter(index.runs.values())))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan


def test_the_query_compacts(spark, monkeypatch):
    made = []
    compact = substrings.FingerprintIndex.compact
    monkeypatch.setattr(substrings.FingerprintIndex, "compact", lambda self: (made.append(len(self.runs)), compact(self)))
    rows = sample(2)
    got = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows) and made == [3]
