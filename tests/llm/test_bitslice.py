import math
import random

import numpy as np

from corpusloom.llm import bitslice
from corpusloom.llm.bitslice import Shard, top_inner_products


def test_shard_equals_brute_force():
    rng = np.random.default_rng(11)
    for n, dims, span in ((1, 3, 5), (70, 5, 900), (200, 1, 2), (130, 8, 1 << 20)):
        values = rng.integers(-span, span + 1, (n, dims))
        ids = rng.permutation(n * 2)[:n]
        shard = Shard.build(ids, values)
        for _ in range(8):
            q = rng.integers(-span, span + 1, dims)
            own = int(ids[0])
            got_ids, got = shard.top(own, q, 10)
            want = sorted(((-int(s), int(i)) for i, s in zip(ids, values @ q) if i != own))[:10]
            assert sorted(zip((-got).tolist(), got_ids.tolist())) == want


def test_query_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bitslice, "SHARD_ROWS", 50)
    monkeypatch.setattr(bitslice, "QUERY_BYTES", 50)
    rng = random.Random(12)
    rows = [(i, [rng.choice([-0.5, 0.25, rng.uniform(-1, 1)]) for _ in range(4)]) for i in range(160)]
    rows += [(200, None), (300, [0.1, None, 0.2, 0.3]), (400, [math.nan, 1.0, 1.0, 1.0]), (500, [math.inf, 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (600, [2.0, 3.0])]
    rows += [(7, rows[7][1])] * 3
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    sound = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, a in sound:
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound if i != q and len(b) == len(a))[:10]
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    got = [tuple(r) for r in top_inner_products(df).collect()]
    assert set(got) == want
    assert top_inner_products(df.limit(0)).count() == 0


def test_large_components_take_part(spark):
    rows = [(0, [3e6, -1.0]), (1, [2.5e6, 1e5]), (2, [-4e5, 7.0]), (3, [1.0, -3e6]), (100, [2.2e6, 1e3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in top_inner_products(df).collect()]
    whole = {i: [int(1024 * x) for x in v] for i, v in rows}
    want = []
    for q in (0, 100):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert sorted(got) == want
