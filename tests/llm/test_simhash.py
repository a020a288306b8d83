import random

import numpy as np
import xxhash

from corpusloom.llm.components import components
from corpusloom.llm.simhash import ball_keys, fingerprint, near_duplicates


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if bin(prints[a] ^ prints[b]).count("1") <= 3 and label[a] > label[b]:
                    label[a] = label[b]
                    changed = True
    return label


def test_groups_equal_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["Alpha", "beta", "Gamma", "délta", "x"]) + str(rng.randint(0, 60)) for _ in range(rng.randint(1, 400))) for _ in range(12)]
    docs = {}
    for i in range(120):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 9)}"
        docs[i * 2 + 1] = " ".join(words)
    docs |= {500: None, 501: "", 502: " \t", 503: "One Two", 504: "one two", 505: "É"}
    df = spark.createDataFrame([(k, v, 1) for k, v in docs.items()], "doc_id long, text string, _fp int").repartition(3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(df).collect()}
    prints = {k: brute_print(v) for k, v in docs.items()}
    assert {k: v[0] for k, v in got.items()} == {k: f"{p:016x}" for k, p in prints.items()}
    assert {k: v[1] for k, v in got.items()} == brute_groups(prints)


def test_any_pair_within_radius_meets():
    rng = random.Random(5)
    keys = ball_keys()
    emit = lambda x: {(x & (m % (1 << 64))) ^ (f % (1 << 64)) for m, f in keys}
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        assert emit(a) & emit(b)


def test_hot_group_of_near_prints(spark):
    values = [(1 << b) | (1 << c) for b in range(12) for c in range(b)]
    from corpusloom.llm.simhash import forest

    edges = list(forest(np.array(values, dtype=np.uint64), 3))
    assert len(edges) == len(values) - 1


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    label.pop(7) if label[7] == 7 and 7 not in got else None
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    rows = near_duplicates(df).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("1", "1"), ("1", "1"), ("None", "1"), ("None", "None")]
    assert near_duplicates(df.limit(0)).count() == 0
    assert fingerprint(b"") == 0


def test_very_long_text(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "other")], "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(df).collect()}
    assert got[1][0] == f"{brute_print(long):016x}" and got[2][1] == 1 and got[3][1] == 3
