import random
import re

from pyspark.sql import functions as F

from lodestack.llm import mixing

SCHEMA = "doc_id long, text string, source string, whole string"


def water(sizes):
    """Targets by rounds: clamp whoever is above, share the rest among the others by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        w = sum(weight[s] for s in free)
        share = {s: weight[s] * (total - sum(fixed.values())) / w for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: 3 * sizes[s] for s in over})


def test_against_rounds_of_clamping(spark):
    rng = random.Random(3)
    rows = []
    for source, docs in [("a", 400), ("b", 3), ("é", 60), ("Z", 9), (None, 30), ("empty", 2), ("c", 1)]:
        for _ in range(docs):
            text = " ".join(["w"] * rng.randrange(1, 60)) if source != "empty" else rng.choice(["", None, " \n"])
            rows.append((len(rows), text, source, "x"))
    rows += [rows[0]] * 3
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.mix(df).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    sizes = {}
    for i, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    want, source_of, taken = water(sizes), {i: s for i, _, s, _ in rows}, dict.fromkeys(sizes, 0)
    assert len(got) == len(rows)
    for r in got:
        s = source_of[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert r.taken == r.size * r.copies and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    again = mixing.mix(df.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    copies = {r.doc_id: r.copies for r in got}
    kept = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert kept == {i: n * (4 if i == 0 else 1) for i, n in copies.items() if n}


def test_no_words_and_no_rows(spark):
    empty = spark.createDataFrame([(1, None, "a", ""), (2, "", None, "")], SCHEMA)
    assert sorted(tuple(r) for r in mixing.mix(empty).collect()) == [(1, 0, 0, 0.0, 0, 0), (2, 0, 0, 0.0, 0, 0)]
    assert mixing.mix(empty.where(F.lit(False))).collect() == []
