import random

import numpy as np
import pytest

import corpus_pipeline
from lodestack.llm import neardup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, n=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def edited(rng, words, rate):
    return [rng.choice([w.upper(), f"new{rng.random():.4f}"]) if rng.random() < rate else w for w in words]


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(4000)]
    rows = []
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.choice([30, 120, 500]))
        rows.append(words)
        for _ in range(rng.choice([0, 0, 1, 4])):
            rows.append(edited(rng, words, rng.choice([0, 0.005, 0.015, 0.08])))
    texts = [" ".join(w) for w in rows] + ["", " ", None, "one", "One", "a b c", "a b d"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i * 3, texts[k], "en", f"src{i % 3}", 0) for i, k in enumerate(order)]


def test_near_duplicate_classes(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = {r.doc_id: r.class_id for r in neardup.duplicate_classes(df).collect()}
    sets = {d: shingles(t) for d, t, *_ in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    pairs = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {d: root(d) for d in sets}
    assert set(got) == set(want)
    assert all(want[d] == want[c] for d, c in got.items())  # nothing joined that is not similar
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs) > 20
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({*got.values()})


EDITS = {
    "appended": lambda rng, w, new: w + new[: len(w) // 5],
    "prepended": lambda rng, w, new: new[: len(w) // 5] + w,
    "inserted": lambda rng, w, new: w[: len(w) // 2] + new[: len(w) // 6] + w[len(w) // 2 :],
    "cut to 85 %": lambda rng, w, new: w[: -(-len(w) * 85 // 100)],
    "middle lost": lambda rng, w, new: w[: len(w) // 2] + w[len(w) // 2 + len(w) // 8 :],
    "passage exchanged": lambda rng, w, new: w[: -(len(w) // 12)] + new[: len(w) // 12],
}


@pytest.mark.parametrize("common", [0, 100_000])
def test_passages_gained_or_lost_are_all_found(spark, monkeypatch, common):
    monkeypatch.setattr(neardup, "COMMON_MOST", common)
    rng = random.Random(17)
    vocabulary = [f"v{i}" for i in range(4000)]
    boilerplate = rng.choices(vocabulary, k=30)
    texts, pairs = [], []
    for kind, edit in EDITS.items():
        for size in [40, 100, 300, 700] * 5:
            words = rng.choices(vocabulary, k=size) + boilerplate * (size > 100)
            changed = edit(rng, words, rng.choices(vocabulary, k=size))
            if jaccard(shingles(" ".join(words)), shingles(" ".join(changed))) >= 0.8:
                pairs.append((kind, len(texts), len(texts) + 1))
            texts += [" ".join(words), " ".join(changed)]
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in neardup.duplicate_classes(spark.createDataFrame(rows, DOCS).repartition(4)).collect()}
    assert {kind for kind, *_ in pairs} == set(EDITS) and len(pairs) > 90
    assert [(kind, a) for kind, a, b in pairs if got[a] != got[b]] == []
    joined = {(a, a + 1) for _, a, _ in pairs}
    assert all(got[i] == i or (got[i], i) in joined for i in got)  # nothing joined that is not similar


def test_near_duplicate_edges(spark):
    rows = [(1, "a b c d e f", "", "", 0)] * 3 + [(2, "A b c d e  f", "", "", 0), (None, "a b c d e f", "", "", 0), (5, None, "", "", 0), (6, "", "", "", 0), (7, "long " * 30_000, "", "", 0)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS t1", "2 AS node", "3 AS unit", "4 AS class_id")
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 5, 7, None]
    assert neardup.keep_one(df.limit(0)).collect() == []


def test_tiles_see_every_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 3)
    rng = random.Random(1)
    base = rng.choices([f"v{i}" for i in range(900)], k=400)
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :]), "", "", 0) for i, k in enumerate(rng.sample(range(400), 20))]
    got = neardup.duplicate_classes(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.class_id for r in got} == {0}


def test_similarity_of_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, n, np.uint64)) for n in (0, 0, 5, 20, 200, 200, 200)] + [np.arange(8000, dtype=np.uint64), np.arange(100, 8000, dtype=np.uint64)]
    want = [[jaccard(set(a.tolist()), set(b.tolist())) >= 0.8 for b in sets] for a in sets]
    assert neardup.similar(sets, 0.8).tolist() == want


def test_stages_end_to_end(spark, tmp_path):
    rng = random.Random(4)
    rows = [(d, t if (t or "").strip() else f"text number {d} of its own kind with some length", lang, s, n) for d, t, lang, s, n in corpus(9)]
    item = " ".join(f"bench{i}" for i in range(20))
    rows += [(9000 + i, " ".join(rng.choices([f"v{k}" for k in range(4000)], k=50)) + " " + item, "en", "src1", 0) for i in range(5)]
    rows += [(9500 + i, " ".join(rng.choices(["BAD!!", "WORSE!!", f"JUNK{i}!!", "SPAM!!"], k=200)), "en", "src2", 0) for i in range(40)]
    labels = [(d, int(d < 9500), 0) for d, *_ in rows if d % 5]
    for name, data, schema in (("documents", rows, DOCS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, item)], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert not {d for d in ids if d >= 9000} and len(ids) > 40
    assert set(out[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "shard", "shard_bytes", "shard_docs"}
    assert all(r.shard_docs == len(out) and r.shard == "" for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and corpus_pipeline.ORACLE_SQL is None


def test_shingles_are_counted_in_all_documents(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randrange(9))) if i % 50 else None, "", "", 0) for i in range(12_000)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    known, cells = neardup.WordHashes(), np.uint64(neardup.COMMON_MOST)
    sets = {d: neardup.shingles_of((t or "").encode(), known)[2] for d, t, *_ in rows}
    want = np.bincount((np.concatenate([*sets.values()]) % cells).astype(int), minlength=neardup.COMMON_MOST)
    assert np.array_equal(neardup.common_shingles(df, 5), want) and want.max() > 1
    for r in neardup.described(df, 5, 0.8).select("doc_id", "keys").collect():
        times = want[[(k & (1 << 64) - 1) % int(cells) for k in r["keys"]]] if r["keys"] else np.empty(0, int)
        left = np.sort(want[(sets[r.doc_id] % cells).astype(int)])
        assert times.tolist() == left[: len(times)].tolist()
    assert not neardup.common_shingles(df.limit(0), 5).any()
