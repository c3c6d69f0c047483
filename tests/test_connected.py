"""Connected groups by contraction."""

import random

from loamline.operators import graph
from loamline.operators.graph import connected


def labels(df):
    return {r["id"]: r["label"] for r in df.collect()}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    jump = graph._to_roots
    monkeypatch.setattr(graph, "_to_roots", lambda up: rounds.append(1) or jump(up))
    order = list(range(4096))
    random.Random(3).shuffle(order)
    chain = spark.createDataFrame(list(zip(order, order[1:])), "id long, other long")
    assert labels(connected(chain)) == dict.fromkeys(order, 0)
    assert len(rounds) <= 24


def test_groups_against_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(500, k) for k in range(501, 700)] + [(7, 7), (900, 900)]
    parent = {k: k for link in links for k in link}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        low, high = sorted((top(a), top(b)))
        parent[high] = low
    rows = spark.createDataFrame([*links, *links[:5], (None, 3), (4, None)], "id long, other long")
    assert labels(connected(rows)) == {k: top(k) for k in parent}
    assert connected(rows.where("false")).count() == 0
