import random
import re
from collections import defaultdict

from corpusloom.llm.mixing import mixed, taken_words


def water_fill(sizes, weights):
    total, left = sum(sizes.values()), dict(sizes)
    targets, capped = {}, set()
    while True:
        open_ = [s for s in sizes if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / max(1e-12, sum(weights[s] for s in open_)) if open_ else 0
        over = {s for s in open_ if level * weights[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: 3 * sizes[s] if s in capped else level * weights[s] for s in left}
        capped |= over


def test_mix(spark):
    rng = random.Random(14)
    rows = []
    for i in range(900):
        source = rng.choice(["b"] * 6 + ["a", "c", "é", None, "z"])
        rows.append((i, None if i % 50 == 0 else "\t".join(["w"] * rng.randint(0, 60)) + " x", source, "c"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string").repartition(4)
    got = taken_words(df).collect()
    assert len(got) == len(rows)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    source = {i: s for i, _, s, _ in rows}
    sizes = defaultdict(int)
    for i in size:
        sizes[source[i]] += size[i]
    order = sorted(s for s in sizes if s is not None) + [None]
    want = water_fill(sizes, {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)})
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[source[r.doc_id]] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 61, (s, taken[s], want[s])
    again = {r.doc_id: r.taken for r in taken_words(df.repartition(2)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    clash = mixed(df.withColumnRenamed("target", "copies"))
    assert clash.columns == [*df.withColumnRenamed("target", "copies").columns, "copies_", "taken"]
    picks = {r.doc_id: (r.copies_, r.taken) for r in clash.collect()}
    assert {k: v[1] for k, v in picks.items() if v[1]} == {k: v for k, v in again.items() if v}


def test_mix_edges(spark):
    assert taken_words(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, None, None), (2, "", "t")]
    got = taken_words(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((str(r.doc_id), r["size"], r.taken, r.target) for r in got) == [("1", 2, 2, 4.0), ("1", 2, 2, 4.0), ("2", 0, 0, 0.0), ("None", 0, 0, 0.0)]
    one = taken_words(spark.createDataFrame([(None, "a b c", "s"), (3, "x", None)], "doc_id long, text string, source string")).collect()
    assert {(r.doc_id, r.taken) for r in one} == {(None, 3), (3, 1)}
