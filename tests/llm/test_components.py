import random

import numpy as np

from corpusloom.llm import components as module
from corpusloom.llm.components import components, least_reachable


def brute(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            least = min(label[a], label[b])
            changed |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    return label


def graphs(seed):
    """Random graphs, a chain with its names dealt out at random, stars of large and small centers, negative ids."""
    rng = random.Random(seed)
    names = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(200)]
    yield [(rng.randrange(300), rng.randrange(300, 500)) for _ in range(220)]
    yield list(zip(names, names[1:], strict=False))
    yield [(max(names), n) for n in names if n != max(names)] + [(5, 6), (6, 5), (5, 6)]
    yield [(min(names), n) for n in names if n != min(names)]
    yield [(a, b) for k in range(0, 200, 20) for a in names[k : k + 20] for b in names[k : k + 20] if a < b]


def test_least_reachable():
    for seed in range(20):
        for edges in graphs(seed):
            nodes, least = least_reachable(*np.array(edges, dtype=np.int64).T)
            assert dict(zip(nodes.tolist(), least.tolist(), strict=True)) == brute(edges)
    assert [len(x) for x in least_reachable(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


def test_small_graph_takes_no_rounds(spark, monkeypatch):
    """A graph that one task can hold is written once; rounds cost the driver seven shuffles each, however few the edges."""
    written = []
    stash = module.stash
    monkeypatch.setattr(module, "stash", lambda df, name: written.append(name) or stash(df, name))
    for edges in list(graphs(1))[1:3]:
        written.clear()
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == brute(edges)
        assert written == ["edges"]


def test_larger_graph_takes_rounds(spark):
    for edges in list(graphs(2))[:2]:
        df = spark.createDataFrame(edges, "a long, b long")
        rounds = sorted(map(tuple, components(df, alone=0).collect()))
        assert rounds == sorted(map(tuple, components(df).collect())) == sorted(brute(edges).items())
    assert components(df.limit(0), alone=0).count() == 0
