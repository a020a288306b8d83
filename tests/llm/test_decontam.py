import random
from collections import Counter

import numpy as np

from corpusloom.llm import decontam
from corpusloom.llm.decontam import ItemIndex, benchmark_matches, shingle_codes, weighted_similarity, without_matches, word_codes
from corpusloom.llm.repeats import WordCodes
from corpusloom.llm.simhash import bit_votes, pack
from corpusloom.llm.window_prints import window_prints


def shingles(words):
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def brute(docs, items):
    out = set()
    for d, text in docs.items():
        words = (text or "").lower().split()
        for i, item in items.items():
            own = (item or "").lower().split()
            if not own or not words:
                continue
            size = min(len(own), len(words))
            if len(words) < min(5, len(own)):
                continue
            best = max(weighted_similarity(shingles(words[s : s + size]), shingles(own)) for s in range(len(words) - size + 1))
            if best >= 0.8:
                out.add((d, i, round(best, 9)))
    return out


def data():
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 40))
    items = {i: " ".join(word() for _ in range(rng.randint(1, 60))) for i in range(30)} | {90: None, 91: "", 92: "One two THREE"}
    docs = {}
    for d in range(150):
        words = [word() for _ in range(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 2)):
            item = (items[rng.randrange(30)]).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                item[rng.randrange(len(item))] = "zz"
            if rng.random() < 0.3:
                item = item[: int(len(item) * 0.9)]
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() if rng.random() < 0.2 else w for w in item]
        docs[d] = " ".join(words)
    docs |= {900: None, 901: "", 902: "x one TWO three y", 903: items[3]}
    return docs, items


def test_matches_equal_brute_force(spark, monkeypatch):
    docs, items = data()
    df = spark.createDataFrame([(k, v, "c") for k, v in docs.items()], "doc_id long, text string, _item string").repartition(3)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = brute(docs, items)
    got = {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in benchmark_matches(df, bench).collect()}
    assert got <= want and {w for w in want if w[2] == 1} <= got and len(got) >= 0.95 * len(want)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1500)
    assert {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in benchmark_matches(df, bench).collect()} == got
    assert {r.doc_id for r in without_matches(df, bench).collect()} == set(docs) - {w[0] for w in got}
    assert benchmark_matches(df, bench.limit(0)).count() == 0 and benchmark_matches(df.limit(0), bench).count() == 0


def edited(rng, words):
    """An item's words with some edits that leave it about 0.8 alike: single words, a cut end, or words put in."""
    words = list(words)
    for _ in range(rng.randint(1, 3)):
        kind = rng.random()
        at = rng.choice([0, len(words) - 1]) if kind < 0.4 else rng.randrange(len(words))
        if kind < 0.7:
            words[at] = f"q{rng.random()}"
        elif kind < 0.85:
            words.insert(at, f"q{rng.random()}")
        else:
            words = words[: len(words) - max(1, len(words) // 12)]
    return words


def test_recall_against_brute_force():
    """Of passages 0.8 or more like an item, at any place of long texts; word for word ones are all found."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 3000)}"
    items = [[word() for _ in range(rng.randint(15, 60))] for _ in range(120)]
    index = ItemIndex([(i, " ".join(w).encode()) for i, w in enumerate(items)])
    known, texts, want, verbatim = WordCodes(), [], set(), set()
    for d in range(900):
        i = rng.randrange(len(items))
        passage = items[i] if d % 3 == 0 else edited(rng, items[i])
        left, right = ([word() for _ in range(rng.randint(0, 200))] for _ in range(2))
        words = left + passage + right
        size = len(items[i])
        best = max(weighted_similarity(shingles(words[s : s + size]), shingles(items[i])) for s in range(max(0, len(left) - size), min(len(words) - size, len(left) + size) + 1)) if len(words) >= size else 0
        if best >= 0.8:
            want.add((d, i, round(best, 9)))
            if d % 3 == 0:
                verbatim.add((d, i, 1.0))
        texts.append(word_codes(" ".join(words).encode(), known))
    got = {(d, i, round(s, 9)) for d, i, _, _, s in decontam.text_matches(texts, index, 0.8)}
    assert verbatim <= got and got <= want
    near = want - verbatim
    print("recall of near passages", len(got & near) / len(near), len(near))
    assert len(near) > 150 and len(got & near) / len(near) >= 0.95


def test_fingerprints_reject_and_decide(monkeypatch):
    """Nearly all windows are turned down by their fingerprint, and without the block index nothing is found."""
    rng = random.Random(12)
    words = [f"w{rng.randint(0, 3000)}" for _ in range(30_000)]
    items = [[f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(15, 60))] for _ in range(50)]
    words[5000:5000] = items[7]
    index = ItemIndex([(i, " ".join(w).encode()) for i, w in enumerate(items)])
    text = word_codes(" ".join(words).encode(), WordCodes())
    classes = index.lookup()[5][0]
    tried = sum(len(text) // s * len(p.prints) for (s, m), p in classes.items())
    near = sum(len(d) for d, _, _ in decontam.candidates([shingle_codes(text, 5)], classes))
    assert 0 < near < tried / 5000
    assert [(m[1], m[2]) for m in decontam.text_matches([text], index, 0.8)] == [(7, 5000)]
    monkeypatch.setattr(decontam.PrintIndex, "near", lambda self, windows: (np.zeros(0, int), np.zeros(0, int)))
    assert decontam.text_matches([text], index, 0.8) == []


def test_block_index_holds_all_within_radius():
    rng = random.Random(10)
    prints = [rng.getrandbits(64) for _ in range(40)]
    index = decontam.PrintIndex(prints, list(range(40)), [0] * 40)
    windows, want = [], set()
    for n in range(500):
        window = rng.choice(prints)
        for bit in rng.sample(range(64), rng.randint(0, 20)):
            window ^= 1 << bit
        windows.append(window)
        want |= {(n, i) for i, p in enumerate(prints) if (p ^ window).bit_count() <= decontam.RADIUS}
    assert set(zip(*(x.tolist() for x in index.near(np.array(windows, dtype=np.uint64))))) == want
    assert len(shingle_codes(word_codes(b"a b c", WordCodes()), 5)) == 1


def test_window_prints_equal_votes():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2)
    for stride in (1, 3):
        for m, prints in window_prints(hashes, stride, [1, 2, 5, 6, 13, 40]):
            size = m * stride
            assert prints.tolist() == [pack(bit_votes(hashes[j * stride : j * stride + size]) * 2 > size) for j in range(len(hashes) // stride - m + 1)]
    for n in range(1, 3000):
        stride, m = decontam.window_class(n)
        assert stride * m + stride - 1 <= n and (n < 9 or stride * m >= 0.6 * n)


def test_long_texts_go_in_chunks(monkeypatch):
    rng = random.Random(13)
    items = [[f"w{rng.randint(0, 500)}" for _ in range(n)] for n in (3, 20, 400)]
    index = ItemIndex([(i, " ".join(w).encode()) for i, w in enumerate(items)])
    words = [f"v{rng.randint(0, 500)}" for _ in range(9000)]
    for at, i in ((8000, 1), (4000, 2), (2990, 0), (0, 1)):
        words[at:at] = items[i]
    text = word_codes(" ".join(words).encode(), WordCodes())
    monkeypatch.setattr(decontam, "CHUNK", 3000)
    assert [m[1] for m in decontam.text_matches([text], index, 0.8)] == [0, 1, 2]


def test_rows_are_judged_by_text_not_id(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(None, f"x {item} y"), (None, "clean one"), (4, item), (4, "clean two"), (5, None), (6, item.upper()), (5, "")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n int")
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    got = without_matches(df, bench)
    assert got.schema == df.schema
    assert sorted(r.n for r in got.collect()) == [1, 3, 4, 6]
    assert without_matches(df, bench.limit(0)).count() == len(rows)
