import random

import numpy as np

from corpusloom.llm import near_copies
from corpusloom.llm.near_copies import long_fingerprint, near_groups, one_of_each, plain_words, shingle_hashes, tree


def shingles(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(texts, similarity=0.8):
    """Least key of each group linked by copies of words or by similar shingles."""
    sets = {k: shingles(t) for k, t in texts.items()}
    label = {k: k for k in texts}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            same = (texts[a] or "").lower().split() == (texts[b] or "").lower().split()
            if same or (sets[a] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def corpus(seed, bases=40, copies=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    texts = {}
    for _ in range(bases):
        words = [word() for _ in range(rng.randint(30, 300))]
        texts[len(texts)] = " ".join(words)
        for _ in range(rng.randint(0, copies)):
            other = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 40))):
                other[rng.randrange(len(other))] = word()
            texts[len(texts)] = " ".join(other)
    return texts


def test_groups_against_brute_force(spark):
    texts = corpus(1) | {900: None, 901: "", 902: " \t", 903: "One two", 904: "one  TWO", 905: "É"}
    want = brute(texts)
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in texts.items()], "doc_id long, text string, _node int, component string").repartition(3)
    got = one_of_each(df)
    assert got.columns == df.columns
    kept = {r.doc_id for r in got.collect()}
    assert set(want.values()) <= kept  # no text goes without a link
    gone = set(texts) - set(want.values())
    print("near copies removed", len(gone - kept) / len(gone), len(gone))
    assert len(gone) > 60 and len(gone - kept) >= 0.95 * len(gone)
    assert one_of_each(df.limit(0)).count() == 0


def test_links_are_all_verified(spark):
    """Texts under the similarity stay, however near their fingerprints are."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(30):
        other = list(words)
        for at in rng.sample(range(5, 190, 5), 4):  # two texts share 156 to 176 of 196 shingles: 0.66 to 0.81 alike
            other[at] = f"n{rng.random()}"
        rows.append((i, " ".join(other)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = set(brute(dict(rows)).values())
    assert len(want) > 20 and want <= {r.doc_id for r in one_of_each(df).collect()}
    assert one_of_each(df, similarity=0.6).count() < 10


def test_hot_family(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        other = list(words)
        for _ in range(3):
            other[rng.randrange(300)] = f"n{rng.random()}"
        rows.append((i, " ".join(other) if i else " ".join(words)))
    monkeypatch.setattr(near_copies, "TREE", 50)
    kept = [r.doc_id for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert 0 in kept and len(kept) <= 8


def test_links_beyond_the_nearest_are_verified(spark, monkeypatch):
    """Which links come first changes no group: a text's nearest may fail where a farther one holds."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(24):
        other = list(words)
        for at in rng.sample(range(5, 110, 5), 2 + i % 2):
            other[at] = f"n{rng.randrange(6)}"
        rows.append((i, " ".join(other)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = []
    for nearest in (1, 1000):
        monkeypatch.setattr(near_copies, "NEAREST", nearest)
        groups.append(sorted(map(tuple, near_groups(df)[1].collect())))
    assert groups[0] == groups[1] and 1 < len({c for _, c in groups[0]}) < len(groups[0])


def test_one_row_of_each_group_whatever_the_ids(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdefg"]
    a, b, c, d, e, f, g = texts
    rows = [(3, a), (7, a), (7, b), (None, c), (None, d), (None, d), (None, a), (9, e), (9, f), (4, f), (None, None), (None, ""), (5, g), (5, g)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, _text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in one_of_each(df).collect()]
    assert len([r for r in kept if not r[1]]) == 1
    assert sorted((r for r in kept if r[1]), key=str) == sorted([(3, a), (7, b), (None, c), (None, d), (9, e), (4, f), (5, g)], key=str)


def test_tree_is_shortest():
    rng = np.random.default_rng(5)
    values = np.unique(rng.integers(0, 1 << 10, 40).astype(np.uint64))
    edges = list(tree(values, 64))
    assert len(edges) == len(values) - 1
    bits = lambda a, b: int(values[a] ^ values[b]).bit_count()
    group, total = list(range(len(values))), 0
    for d, a, b in sorted((bits(a, b), a, b) for a in range(len(values)) for b in range(a)):
        if group[a] != group[b]:
            group = [group[a] if x == group[b] else x for x in group]
            total += d
    assert sum(bits(a, b) for a, b in edges) == total


def test_fingerprints_of_pieces_and_keys(spark):
    words = plain_words(b"One two THREE four five six seven")
    hashes = shingle_hashes(words)
    assert len(hashes) == 3 and len(shingle_hashes(words[:2])) == 1 and not len(shingle_hashes([]))
    many = np.arange(5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    salted = near_copies.mix(many ^ near_copies._SALTS[3])
    assert int(long_fingerprint(many)[3]) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in salted) > len(many))
    rng = random.Random(6)
    fp = [rng.getrandbits(64) for _ in range(8)]
    df = spark.createDataFrame([([x - (1 << 64) if x >> 63 else x for x in fp],)], "fp array<bigint>")
    got = df.select(near_copies.ball_keys(near_copies.F.col("fp")).alias("k")).first().k
    parts = [v for x in fp for v in (x & 0xFFFFFFFF, x >> 32)]
    assert sorted(got) == sorted((p << 32) + (v ^ f) for p, v in enumerate(parts) for f in (0, *(1 << b for b in range(32))))


def family(seed, n, places, choices):
    """Texts of 120 words that differ from one text in some of the given places."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        other = [f"w{j}" for j in range(120)]
        for at in rng.sample(range(5, 110, 5), rng.choice(places)):
            other[at] = f"n{rng.randrange(choices)}"
        rows.append((i, " ".join(other)))
    return rows


def test_no_link_of_a_family_is_left_out(spark, monkeypatch):
    """Every link among texts that meet counts, those on no shortest tree too, in blocks of one piece and of many."""
    rows = family(11, 200, (2, 3, 4), 3)
    want = brute(dict(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert 10 < len(set(want.values())) < 190
    for tree_size in (2048, 30):
        monkeypatch.setattr(near_copies, "TREE", tree_size)
        assert {r.doc_id for r in one_of_each(df).collect()} == set(want.values()), tree_size


def test_links_do_not_grow_with_the_square(spark, monkeypatch):
    """Texts that share a part are joined before the variants, which then link no family to itself."""
    made = {}
    real = near_copies.stash
    monkeypatch.setattr(near_copies, "stash", lambda df, name: made.setdefault(name, []).append(real(df, name)) or made[name][-1])
    monkeypatch.setattr(near_copies, "drop_stash", lambda df: None)
    near_groups(spark.createDataFrame(family(12, 400, (1, 2), 50), "doc_id long, text string"))
    assert made["near-links"][0].count() < 400 and made["near-wanted"][0].count() <= 400
