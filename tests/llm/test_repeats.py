import random

import numpy as np
import pytest

from corpusloom.llm import repeats
from corpusloom.llm.automaton_dedup import SuffixAutomaton, automaton_dedup
from corpusloom.llm.suffix import equal_windows, suffix_array
from corpusloom.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id long, text string, _key string, _at string"


def brute_bytes(docs, size):
    seen, out = set(), {}
    for key in sorted(docs):
        text = (docs[key] or "").encode()
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - size + 1):
            w = text[i : i + size]
            if w in seen:
                gone[i : i + size] = True
            seen.add(w)
        out[key] = (len(text), int(gone.sum()), bytes(b for b, g in zip(text, gone) if not g))
    return out


def brute_words(docs, size):
    seen, out = set(), {}
    for key in sorted(docs):
        words = (docs[key] or "").encode().split()
        gone = np.zeros(len(words), bool)
        own = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
        for i, w in enumerate(own):
            if w in seen:
                gone[i : i + size] = True
        seen |= set(own)
        out[key] = (len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone) if not g))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4)))
    shared = [" ".join(word() for _ in range(rng.randint(5, 90))) for _ in range(6)]
    docs = {}
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(rng.randint(0, 5))]
        docs[i * 3] = " ".join(parts)
    docs[7] = docs[3]  # copies
    docs[8] = docs[3] + "x"
    docs[10] = None
    docs[11] = ""
    docs[13] = "ab" * 400  # periodic
    docs[14] = "a" * 900
    docs[16] = ("é" * 30 + " \t\n") * 20
    docs[17] = "z " * 300
    docs[19] = "z " * 120
    return docs


@pytest.mark.parametrize("group", [400, 5, 1])
def test_suffix_dedup_equals_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    docs = corpus(group)
    df = spark.createDataFrame([(k, v, "x", None) for k, v in docs.items()], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_dedup(df, size=60, k=20).collect()}
    assert got == brute_bytes(docs, 60)


@pytest.mark.parametrize("group", [400, 5, 1])
def test_automaton_dedup_equals_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    docs = corpus(group + 5)
    df = spark.createDataFrame([(k, v, "x", None) for k, v in docs.items()], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in automaton_dedup(df, size=20, k=6).collect()}
    assert got == brute_words(docs, 20)


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "short"), (2, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in automaton_dedup(df).collect())
    assert got == [("1", 60, 0), ("1", 60, 0), ("2", 0, 0), ("2", 1, 0), ("None", 60, 60)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup(empty).count() == 0


def test_suffix_array_sorts():
    rng = np.random.default_rng(1)
    for _ in range(150):
        s = rng.integers(1, 4, int(rng.integers(0, 50)))
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        near = suffix_array(s, 5)
        assert all(s[a : a + 5].tolist() <= s[b : b + 5].tolist() for a, b in zip(near, near[1:]))
        if len(s) >= 5:
            classes = equal_windows(s, np.arange(len(s) - 4), 5)
            windows = [tuple(s[i : i + 5]) for i in range(len(s) - 4)]
            assert len(set(zip(classes, windows))) == len(set(classes)) == len(set(windows))


def test_automaton_statistics():
    rng = random.Random(2)
    for _ in range(60):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(3)]
        automaton = SuffixAutomaton()
        for t in texts:
            automaton.add(t)
        probe = "".join(rng.choice("abc") for _ in range(12))
        want = [max(n for n in range(j + 2) if any(probe[j + 1 - n : j + 1] in t for t in texts)) for j in range(12)]
        assert automaton.statistics(probe) == want


def test_pieces_of_long_documents(monkeypatch):
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 62, 20_000).astype(np.uint64)
    whole = repeats.document_anchors(codes, 50, 10)
    monkeypatch.setattr(repeats, "MAX_SYMBOLS", 3000)
    parts = repeats.document_anchors(codes, 50, 10)
    for name in ("at", "first", "last", "key", "context"):
        a, b = getattr(whole, name), getattr(parts, name)
        assert (a[2:-2] == b[2:-2]).all() and len(a) == len(b), name


def test_long_windows_are_packed_whole():
    import pyarrow as pa

    from corpusloom.llm.repeats import Words, anchor_batches, document_anchors, unpacked

    rng = random.Random(31)
    text = " ".join(f"w{rng.randint(0, 500)}" for _ in range(4000)).encode()
    want = document_anchors(Words.codes(Words.split(text)), 512, 24)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["_key", "_bytes"])
    got = unpacked(np.concatenate([b.column(1).to_numpy() for b in anchor_batches(iter([batch]), Words, 512, 24)]))
    assert (want.at - want.first).max() > 255
    assert all((g == w).all() for g, w in zip(got, (want.at, want.first, want.last)))


def test_wide_windows_and_hot_passages(spark, monkeypatch):
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    common, long = prose(30), prose(160)
    docs = {i: f"{prose(rng.randint(0, 40))} {common if i % 2 else long} {prose(rng.randint(0, 40))}" for i in range(60)}
    docs[99] = " ".join([common] * 12)  # one document repeats what others have
    docs[98] = " ".join([long + prose(3)] * 3)
    df = spark.createDataFrame([(k, v, "x", None) for k, v in docs.items()], SCHEMA).repartition(4)
    for group in (1500, 3):
        monkeypatch.setattr(repeats, "GROUP", group)
        wide = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_dedup(df, size=400).collect()}
        assert wide == brute_bytes(docs, 400) and sum(x[1] for x in wide.values()) > 10_000
        got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_dedup(df).collect()}
        assert got == brute_bytes(docs, 100)
        words = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in automaton_dedup(df, size=25, k=6).collect()}
        assert words == brute_words(docs, 25)


def test_parts_of_a_context_hold_each_window_once():
    for size, k in ((10, 3), (10, 4), (7, 6), (50, 16), (100, 24)):
        for at, start, last in ((200, 200 + k - size, 200), (200, max(199, 200 + k - size), 200), (200, 200 + k - size, 200 + k - size)):
            level = [(at, k, max(start, at + k - size), last)]
            want = list(range(level[0][2], last + 1))
            while level and level[0][1] < size:
                level = [p for a in level for _, p in (repeats.sub_shards(*a, size) if a[1] < size else [(0, a)])]
                assert sorted(s for _, _, a, b in level for s in range(a, b + 1)) == want
                assert all(a <= g and g + n <= a + size and b <= g and g + n <= b + size for g, n, a, b in level)
            assert all(n <= size for _, n, _, _ in level)
            parts = list(repeats.small_shards(at, k, start, last, size))
            assert len({p[0] for p in parts}) == len(parts) and sorted(s for *_, a, b in parts for s in range(a, b + 1)) == list(range(start, last + 1))
