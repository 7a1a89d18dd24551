import random

import numpy as np
import pytest

from lodestack.llm import graph


def brute(links):
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent}


def some_links(seed, n, m):
    rng = random.Random(seed)
    chain = [(-k, -k - 1) for k in range(1, 40)]
    return chain + [(rng.randrange(n) * 7, rng.randrange(n) * 7) for _ in range(m)]


@pytest.mark.parametrize("few", [0, 30, 1 << 19])
def test_components_by_rounds_and_at_once(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    links = [(a, b) for a, b in some_links(2, 90, 60) if a != b]
    df = spark.createDataFrame([*links, *links[:5], (4, 4), (None, 1), (1, None)], "a long, b long").repartition(3)
    assert {r.node: r.component for r in graph.components(df, "a", "b").collect()} == brute(links)
    assert graph.components(df.where("a < -9999"), "a", "b").collect() == []


def test_few_links_take_no_round(spark, monkeypatch):
    def stopped(*_):
        raise AssertionError("a round")

    monkeypatch.setattr(graph, "_toward_minimum", stopped)
    links = [(k, k + 1) for k in range(200)]
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.component for r in graph.components(df, "a", "b").collect()} == {0}


@pytest.mark.parametrize("n, m", [(50, 20), (300, 280), (300, 2000)])
def test_joined(n, m):
    links = some_links(n + m, n, m)
    u, v = np.array(links, np.int64).T
    assert dict(zip(*(x.tolist() for x in graph.joined(u, v)), strict=True)) == brute(links)
