import random

import numpy as np
import pytest
import xxhash

from lodestack.llm import simhash

DOCS = "doc_id long, text string"


def brute_print(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(n, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, most=2):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, f"{p:016x}", least.get(root(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def as_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for base in range(12):
        words = rng.choices(vocabulary, k=rng.choice([2, 5, 40, 300]))
        for _ in range(rng.choice([1, 3, 9])):
            changed = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary).upper()
            rows.append((len(rows) * 7 % 101, " ".join(changed)))
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, " One word"), (504, "x " * 5000), rows[0], rows[0], (None, rows[1][1]), (None, "alone here now"), (505, "A b"), (506, "a B")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS component_id", "'x' AS fingerprint", "2 AS node", "3 AS lo", "4 AS key")
    assert as_rows(simhash.near_duplicates(df.repartition(3))) == brute(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("m", [3, 5, 6])
def test_pairs_within_two_bits_meet_at_an_anchor(m):
    n, rng = (1 << m) - 1, np.random.default_rng(1)
    for _ in range(200):
        x = int(rng.integers(0, 1 << 63)) & ((1 << n) - 1)
        y = x
        for b in rng.choice(n, size=int(rng.integers(0, 3)), replace=False):
            y ^= 1 << int(b)
        _, a = simhash.anchors(np.array([x], np.uint64), m)
        _, b = simhash.anchors(np.array([y], np.uint64), m)
        assert set(a.tolist()) & set(b.tolist())
        assert all((z ^ x).bit_count() <= 2 for z in a.tolist())


def test_chain_of_links_is_followed_and_wide_gaps_are_not(spark):
    base = 0x0F0F_1234_5678_9ABC
    prints = [(1, base), (2, base ^ 3), (3, base ^ 3 ^ 12), (4, base ^ 3 ^ 12 ^ (1 << 63)), (9, base ^ (7 << 40))]
    df = spark.createDataFrame([(d, p - (1 << 64) if p >> 63 else p, 0) for d, p in prints], "doc_id long, lo long, hi long")
    assert {r.doc_id: r.component_id for r in simhash.classes(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9}


def test_fingerprints_without_an_id_link_others(spark):
    from lodestack.llm.simhash import classes

    rows = [(1, 0b00, 0), (None, 0b11, 0), (2, 0b1111, 0), (None, 0b111111 << 20, 0)]
    got = classes(spark.createDataFrame(rows, "doc_id long, lo long, hi long")).collect()
    assert {(r.doc_id, r.lo): r.component_id for r in got} == {(1, 0): 1, (None, 0b11): 1, (2, 0b1111): 1, (None, 0b111111 << 20): None}


def test_links_of_a_crowd_grow_with_its_members_only(spark):
    from lodestack.llm.simhash import anchor_links

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 2)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3).astype(np.uint64)) for _ in range(8000)], np.uint64)
    prints = (base.astype(np.uint64)[None, :] ^ flips.reshape(-1, 2)).view(np.int64)
    share = []
    for n in (500, 4000):
        nodes = spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(prints[:n])], "node long, lo long, hi long")
        links = anchor_links(nodes, 22, 0).distinct()
        share.append(links.count() / n)
    assert max(share) < 17  # at most one for each of a node's anchors
