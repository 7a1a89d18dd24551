import itertools
import os
import random

import duckdb
import numpy as np
import pytest

from lodestack.llm import decontaminate as d
from lodestack.llm.common import WordHashes

DOCS, ITEMS = "doc_id long, text string, tid string, h int, region int", "item_id long, text string, tokens int, doc_id int"


def brute(docs, items):
    """Every shift of every item over every document."""
    known, out = WordHashes(), {}
    firsts = {}
    for i, t, *_ in items:
        if t is not None:
            firsts[t] = min(i, firsts.get(t, i))
    for (doc_id, text, *_), (t, i) in itertools.product(docs, firsts.items()):
        doc, item = d.tokens_of((text or "").encode(), known), d.tokens_of(t.encode(), known)
        for shift in range(-len(item), len(doc)):
            if got := d.best_overlap(doc, item, shift):
                key = (got[2], got[1], -got[0])
                out[doc_id, i] = max(out.get((doc_id, i), key), key)
    return out


def test_planted_overlaps(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n)), 0, 0) for i, n in enumerate([14, 20, 40, 59, 13, 11, 9, 8, 25])]
    items += [(50, items[1][1], 0, 0), (51, None, 0, 0), (52, "", 0, 0), (53, "of the", 0, 0)]
    docs, planted = [], set()
    for n in range(120):
        words = rng.choices(vocabulary, k=rng.choice([0, 5, 60, 300]))
        if n % 2:
            i = rng.randrange(9)
            passage = items[i][1].split()
            if len(passage) >= 25 and n % 3 == 0:
                passage = passage[4:20]
            for at in rng.sample(range(len(passage)), k=min(n % 3, len(passage) // 8)):
                passage[at] = rng.choice(vocabulary)
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() if n % 5 == 0 else w for w in passage]
            planted.add((n, i))
        docs.append((n, " ".join(words), "", 0, 0))
    docs += [(500, None, "", 0, 0), (501, "", "", 0, 0), (502, "of the " * 4000, "", 0, 0), (503, (items[3][1] + " ") * 20, "", 0, 0), (503, (items[3][1] + " ") * 20, "", 0, 0), (504, items[2][1], "", 0, 0)]
    got = d.leaks(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)).collect()
    found = {(r.doc_id, r.item_id): (r.n_equal, r.n_words, -r.first_word) for r in got}
    want = brute(docs, items)
    assert len(found) == len(got) and set(found) <= set(want)
    assert found == want
    kept = d.without_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert kept.columns == ["doc_id", "text", "tid", "h", "region"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, *_ in docs if i not in {a for a, _ in want})


def test_short_items_and_short_documents(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n)), 0, 0) for i, n in enumerate([1, 3, 7, 8, 10, 12, 13, 30, 60])]
    docs = [(100 + i, t.upper(), "", 0, 0) for i, t, *_ in items]
    docs += [(200 + i, f"before {t} after", "", 0, 0) for i, t, *_ in items]
    n = 300
    for i, text, *_ in items:
        words = text.split()
        for size in range(5, min(13, len(words) + 1)):
            at = rng.randrange(len(words) - size + 1)
            for changed in range(4):
                cut = words[at : at + size]
                for k in rng.sample(range(size), changed):
                    cut[k] = "other"
                docs.append((n, " ".join(cut), "", 0, 0))
                n += 1
    got = d.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    found = {(r.doc_id, r.item_id): (r.n_equal, r.n_words, -r.first_word) for r in got}
    assert found == brute(docs, items) and len(found) == len(got)
    assert {(100 + i, i) for i in range(9)} <= set(found)
    assert not {(200, 0), (201, 1), (202, 2)} & set(found)
    assert any(r.item_words > 13 and r.n_words < 13 for r in got)


def test_items_without_an_id(spark):
    texts = [" ".join(f"{c}{i}" for i in range(20)) for c in "xyz"]
    docs = spark.createDataFrame([(n, f"so {t} on", "", 0, 0) for n, t in enumerate(texts)] + [(9, "clean words only", "", 0, 0)], DOCS)
    items = spark.createDataFrame([(None, texts[0], 0, 0), (None, texts[1], 0, 0), (7, texts[2], 0, 0)], ITEMS)
    assert {(r.doc_id, r.item_id, r.n_equal) for r in d.leaks(docs, items).collect()} == {(0, None, 20), (1, None, 20), (2, 7, 20)}
    assert [r.doc_id for r in d.without_leaks(docs, items).collect()] == [9]


def test_null_ids_and_empty_tables(spark):
    text = " ".join(f"t{i}" for i in range(20))
    docs, items = spark.createDataFrame([(None, text, "", 0, 0)], DOCS), spark.createDataFrame([(3, text, 0, 0)], ITEMS)
    assert [(r.doc_id, r.item_id, r.n_equal) for r in d.leaks(docs, items).collect()] == [(None, 3, 20)]
    assert d.without_leaks(docs, items).collect() == []
    assert d.leaks(docs.limit(0), items).collect() == d.leaks(docs, items.limit(0)).collect() == []


def test_one_or_two_changed_tokens_of_thirteen_leave_a_seed():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 13, np.uint64)
    missed = 0
    for changed in itertools.combinations(range(13), 2):
        other = base.copy()
        other[list(changed)] += np.uint64(1)
        missed += not any(np.any(d.seed_hashes(base, s) == d.seed_hashes(other, s)) for s in d.seeds(set()))
    assert missed == 0
    assert all(sum(map(int, m)) == 6 for m in d.MASKS)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the generated tables")
def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    found = d.op2_decontaminate(spark, sf)
    names = ", ".join(found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(f"SELECT {names} FROM ({d.OP2_SQL})").fetchall())
