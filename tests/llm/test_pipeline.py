import random

import corpus_pipeline
from corpusloom.llm.decontam import weighted_similarity
from tests.llm.test_decontam import shingles
from tests.llm.test_repeats import brute_bytes
from tests.llm.test_near_copies import brute


def write_tables(spark, folder):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(30)) for i in range(5)]
    passage = prose(60)
    docs, marks = {}, []
    for i in range(160):
        text = prose(rng.randint(20, 80))
        toxic = i % 5 == 0
        if toxic:
            words = text.split()
            for w in ("vileword", "vilesome", "vilely"):
                words.insert(rng.randrange(len(words)), w)
            text = " ".join(words)
        elif i % 16 == 1:
            text += " " + items[i % 5][1] + " " + prose(5)
        elif i % 16 == 2:
            text += "\n" + passage + "\n" + prose(5)
        elif i % 16 == 3:
            text = docs[i - 2][0] if i > 16 else text
        toxic = "vile" in text  # copies of toxic texts are toxic
        docs[i] = (text, toxic)
        if i % 4 != 3:
            marks.append((i, 1, int(toxic)))
    rows = [(i, t, rng.choice(["en", "fr"]), rng.choice(["a", "b", None]), len(t)) for i, (t, _) in docs.items()]
    rows += [(500, None, None, "a", None), (501, "", "en", "b", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, {i for i, (_, toxic) in docs.items() if toxic}, items


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, toxic, items = write_tables(spark, str(tmp_path))
    texts = {r[0]: r[1] for r in rows if r[0] not in toxic}
    groups = brute(texts)
    texts = {k: t for k, t in texts.items() if groups[k] == k}
    kept = brute_bytes(texts, 100)
    texts = {k: None if texts[k] is None else v[2].decode("utf-8", "ignore") for k, v in kept.items()}

    def leaks(text):
        words = (text or "").lower().split()
        for _, item in items:
            own = item.lower().split()
            n = min(len(own), len(words))
            if n >= 5 and any(weighted_similarity(shingles(words[s : s + n]), shingles(own)) >= 0.8 for s in range(len(words) - n + 1)):
                return True
        return False

    texts = {k: t for k, t in texts.items() if not leaks(t)}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
    assert {r.doc_id: r.text for r in docs.collect()} == texts
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3]
    mix = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in mix} <= set(texts) and all(r.taken == r.copies * len((r.text or "").split()) and 1 <= r.copies <= 3 for r in mix)
    total = sum(len((t or "").split()) for t in texts.values())
    assert abs(sum(r.taken for r in mix) - total) < 300
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.queries().keys() == {"pipeline"}


def test_stages_take_any_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, repeated rows, clashing columns and empty tables, through each stage."""
    write_tables(spark, str(tmp_path))
    long = " ".join(f"w{i * i % 9973}" for i in range(40_000))
    rows = [(None, None, "a"), (None, "", None), (1, "one text of a few words", "a"), (1, "quite another text of that id", "a"), (2, "one text of a few words", "b"), (2, "one text of a few words", "b")]
    rows += [(None, "a text without an id", None), (7, long, "b"), (8, "é" * 50, "c")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _severity double, copies long, taken string, _key int, _node int, _text string, grade int"
    df = spark.createDataFrame([(i, t, "en", s, len(t) if t else None, 0.5, 9, "t", 1, 2, "x", 3) for i, t, s in rows], schema)
    texts = [r[1] for r in rows]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, df, str(tmp_path))
        assert got.columns == df.columns, name
        kept = got.collect()
        assert all((r._severity, r.copies, r.taken, r._key, r._node, r._text, r.grade) == (0.5, 9, "t", 1, 2, "x", 3) for r in kept), name
        if name == "simhash_near_dedup":
            assert sorted(str((r.doc_id, r.text)) for r in kept if r.text) == sorted(str((i, t)) for i, t in {(i, t) for i, t, _ in rows if t} - {(2, texts[4])})
            assert len([r for r in kept if not r.text]) == 1
        else:
            assert len(kept) == len(rows), name
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    mix = corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path))
    assert mix.columns == [*df.columns, "copies_", "taken_"] and mix.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, df.limit(0), str(tmp_path)).count() == 0
