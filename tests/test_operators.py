import json
from http.client import IncompleteRead

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import annotators, linking, quality, sampling
from corpusloom.sources import fetch, files
from corpusloom.streaming.incremental import resumable, windowed_counts


def test_headers_and_footers(spark):
    pages = ["Head\nbody one\nFoot", "Head\nbody two\nFoot", "", "Other\nHead\nlast"]
    df = spark.createDataFrame([(1, pages), (2, ["only"]), (3, [])], "doc_id int, pages array<string>")
    got = {r.doc_id: r.pages for r in quality.without_headers_footers(df).collect()}
    assert got == {1: ["body one", "body two", "", "Other\nlast"], 2: [""], 3: []}


def test_quality(spark):
    good = "Plain words that make up a page of text, twelve of them at least."
    df = spark.createDataFrame([(good,), ("",), ("12 34",), ("$ " * 40 + good,), (" ".join(["wort"] * 9),)], "text string")
    assert [r.is_good for r in quality.with_quality(df).collect()] == [True, False, False, False, False]


def test_circuit_breaker(spark):
    attempts = [(i, "d", o) for i, o in enumerate([1, 1, 0, 1, 1, 1, 0, 0])] + [(100, "e", 0)]
    df = spark.createDataFrame(attempts, "n int, d string, failed int")
    out = sampling.circuit_breaker(df, "d", F.col("failed") == 1, ["n"]).orderBy("n").collect()
    assert [(r.fails_before, r.skipped) for r in out] == [(0, False), (1, False), (2, False), (1, False), (2, False), (3, True), (3, True), (3, True), (0, False)]


def test_balanced_sample(spark):
    df = spark.createDataFrame([(i, "a" if i < 50 else "b" if i < 53 else "c") for i in range(100)], "id int, lang string")
    got = sampling.balanced_sample(df, "lang", ["a", "b"], 20, "id").collect()
    assert {r.lang: r.quota for r in got} == {"a": 17, "b": 3} and len(got) == 20
    assert {r.id for r in got} == {r.id for r in sampling.balanced_sample(df.repartition(4), "lang", ["a", "b"], 20, "id").collect()}


def test_links(spark):
    docs = spark.createDataFrame([("d", ["abc", "xbc"])], "id string, text array<string>")
    links = spark.createDataFrame([("d", "xb"), ("d", "bc"), ("d", "zz"), ("e", "a")], "doc_id string, entity_text string")
    placed, lost = linking.with_first_chunk(docs, links)
    assert {(r.entity_text, r.chunk_idx) for r in placed.collect()} == {("xb", 1), ("bc", 0)} and [r.entity_text for r in lost.collect()] == ["zz"]
    rows = [("d", "x", 0.9, "1"), ("d", "x", None, "1"), ("d", "", 0.9, "1"), ("d", "x", 0.9, "-1"), ("d", "x", 0.9, "one"), (None, "x", 0.9, "1"), ("d", "x", 0.8, "1")]
    kept = linking.confident_links(spark.createDataFrame(rows, "doc_id string, linked_entity string, confidence double, chunk_idx string")).collect()
    assert [(r.doc_id, r.chunk_idx) for r in kept] == [("d", 1)]


def test_interleave_and_merge(spark):
    a, b = spark.createDataFrame([(3,), (1,), (2,)], "v int"), spark.createDataFrame([(9,), (8,)], "v int")
    assert [(r.idx, r.side, r.v) for r in linking.interleaved(a, b, ["v"]).orderBy("idx", "side").collect()] == [(0, 0, 1), (0, 1, 8), (1, 0, 2), (1, 1, 9)]
    left = spark.createDataFrame([("1", "m", "l"), ("2", "n", "l"), ("3", "m", "l")], "doc_id string, model string, o string")
    right = spark.createDataFrame([("1", "z", "r"), ("2", "z", "r")], "doc_id string, model string, o string")
    assert sorted(tuple(r) for r in linking.merged_outputs(left, right, ["m"]).collect()) == [("1", "z", "r"), ("2", "n", "l"), ("3", "m", "l")]


def test_files(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "socio_1.json.gz", "wt") as f:
        f.write(json.dumps({"id": "a", "url": ["u"], "in_language": ["en"], "abstract": [{"text": "t", "lang": "en"}], "headline": []}) + "\n\n")
    dump = files.read_dump(spark, str(tmp_path)).collect()
    assert [(r.id, r.discipline, r.abstract[0].text) for r in dump] == [("a", "socio", "t")]
    (tmp_path / "broken.txt").write_text('{\n "k": 1\n}\n{\n "k": 2\n}\n{\n "k": \n}\n{\n "k": 4\n}')
    assert sorted(r.k for r in files.repaired_objects(spark, str(tmp_path / "broken.txt"), "k int").collect()) == [1, 2, 4]
    (tmp_path / "array.json").write_text('[{"id": "1"}, {"id": "2"}]')
    assert files.read_json_array(spark, str(tmp_path / "array.json"), "id string").count() == 2
    (tmp_path / "stats.json").write_text(json.dumps({"buckets": [{"key": "en", "doc_count": 3, "by_discipline": {"buckets": [{"key": "x", "doc_count": 2}]}}]}))
    assert [tuple(r) for r in files.read_stats(spark, str(tmp_path / "stats.json")).collect()] == [("en", 3, "x", 2)]
    assert files.prediction_files(["b.json", "a_Time.json", "a.json", "c.txt"]) == ["a.json", "b.json"]
    df = spark.createDataFrame([(1, "é")], "a int, b string")
    files.write_csv(df, str(tmp_path / "csv"))
    files.write_ndjson(df, str(tmp_path / "nd"))
    files.append_ndjson(df, str(tmp_path / "nd"))
    assert files.read_ndjson(spark, str(tmp_path / "nd"), "a int, b string").count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["a", "b"] and json.loads(files.json_array(df)) == [{"a": 1, "b": "é"}]
    (tmp_path / "x.pdf").write_bytes(b"junk %PDF-1.4 1|2|3|4|5|6")
    (tmp_path / "y.pdf").write_bytes(b"junk")
    pdfs = files.read_pdfs(spark, str(tmp_path / "*.pdf"))
    assert pdfs.count() == 1 and files.pdf_pages(pdfs, lambda b: b.decode().split("|")).first().pages[1] == "2"


def test_malformed_files_are_logged(spark, tmp_path):
    (tmp_path / "pred").mkdir()
    (tmp_path / "src").mkdir()
    for name, text in (("a", '[{"doc_id": "1"}, 5, {"doc_id": "2"}]'), ("b", "[1] ?"), ("c", '{"doc_id": "1"}'), ("d", '[{"doc_id": "9"}]')):
        (tmp_path / "pred" / f"{name}.json").write_text(text)
    (tmp_path / "src" / "a.json").write_text('[{"id": "1", "t": "x"}, {"id": "1", "t": "x"}]')
    predictions, log = files.json_files(spark, str(tmp_path / "pred"), "doc_id string")
    name = lambda r: r.file.rpartition("/")[2]
    assert sorted((name(r), r.reason) for r in log.collect()) == [("b.json", "not JSON"), ("c.json", "not an array")]
    found, missing = files.paired(predictions, files.json_files(spark, str(tmp_path / "src"), "id string, t string")[0])
    assert [(r.doc_id, r.document.t) for r in found.collect()] == [("1", "x")]
    assert [(name(r), r.reason) for r in missing.collect()] == [("d.json", "no source file")]
    (tmp_path / "lines").write_text('{"a": 1}\n\n{"a": 2} x\n[1]\n')
    good, bad = files.ndjson_with_log(spark, str(tmp_path / "lines"), "a int")
    assert [r.a for r in good.collect()] == [1] and sorted(r.line for r in bad.collect()) == ["[1]", '{"a": 2} x']


def test_silver_standard_checks_counts(spark):
    from corpusloom.operators.silver import silver_standard

    class Short:
        def annotate(self, texts):
            return []

    docs = spark.createDataFrame([(1, "en", ["Rome", ""]), (2, None, [])], "id int, in_language string, text array<string>")
    links = spark.createDataFrame([("1", "Rome", "kb:1", 0.9, "0", 0)], "doc_id string, entity_text string, linked_entity string, confidence double, chunk_idx string, ord int")
    shown = []

    class Judge:
        def annotate(self, texts):
            return [[{"start": 0, "end": 1, "label": t, "text": "", "confidence": 1.0}] for t in texts]

    model = annotators.Gazetteer({"Rome": "Place"})
    got = {r.chunk_idx: r for r in silver_standard(docs, links, model, Judge(), "g", "j", ["ord"]).collect()}
    assert set(got) == {0, 1} and got[0].annotator_ents[0].text == "Rome" and '["kb:1"]' in got[0].judged_ents[0].label and got[1].annotator_ents == []
    with pytest.raises(Exception, match="gave 0 results"):
        silver_standard(docs, links, model, Short(), "g", "j", ["ord"]).collect()


def test_progress_and_scratch(spark, tmp_path):
    import time

    from corpusloom.shared import clear_scratch, stash
    from corpusloom.streaming.incremental import Progress

    seen = []
    listener = Progress(lambda name, rows: seen.append(rows))
    spark.streams.addListener(listener)
    spark.createDataFrame([(1,), (2,)], "a int").write.json(str(tmp_path / "in"))
    resumable(spark, str(tmp_path / "in"), "a int", lambda df: df, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    for _ in range(50):
        if seen:
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert seen and seen[-1] == 2
    annotators.write_timings(spark, [annotators.timed("m", lambda: None), {"name": "m", "elapsed": 1.5}], str(tmp_path / "t"))
    assert annotators.seconds_by_model(files.read_ndjson(spark, str(tmp_path / "t"), "name string, elapsed double")).first().elapsed >= 1.5
    df = stash(spark.range(3).toDF("a"), "x")
    assert df.count() == 3
    clear_scratch(spark)
    with pytest.raises(Exception):
        df.count()


def test_fetch_tries_twice():
    seen = []

    def get(url, headers):
        seen.append(bool(headers))
        if url == "bad" or (url == "shy" and not headers):
            raise OSError if headers else IncompleteRead(b"")
        return b"x"

    assert fetch.fetched("ok", get) == (b"x", False) and fetch.fetched("shy", get) == (b"x", False) and fetch.fetched("bad", get) == (None, True)
    assert seen == [False, False, True, False, True]


def test_annotators(spark):
    with pytest.raises(ValueError):
        annotators.annotator("none")
    with pytest.raises(ValueError):
        annotators.annotator("llm", ask=lambda p: p)
    model = annotators.annotator("gazetteer", surfaces={"Rome": "Place", "New Rome": "Place"})
    df = spark.createDataFrame([(1, "In New Rome, not Romes."), (2, None)], "id int, text string")
    got = {r.id: [(e.start, e.end, e.text) for e in r.entities] for r in annotators.annotate(df, model, batch=1).collect()}
    assert got == {1: [(3, 11, "New Rome")], 2: []}
    answers = spark.createDataFrame([(1, ["bad", '[{"start":0,"end":1,"label":"L","text":"a","confidence":1}]']), (2, [])], "id int, attempts array<string>")
    assert {r.id: len(r.entities) for r in annotators.answers_to_entities(answers).collect()} == {1: 1, 2: 0}


ANSWER = '[{"start":0,"end":1,"label":"L","text":"%s","confidence":1}]'


def test_answers_stay_with_their_rows(spark):
    rows = [(i, f"extra{i}", ["bad", ANSWER % f"t{i}"] if i % 3 else ["bad", "{'x'", (ANSWER % f"t{i}").replace('"', "'")]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, extra string, attempts array<string>").repartition(7)
    got = annotators.answers_to_entities(df).select("id", "extra", "entities.text").repartition(3).collect()
    assert len(got) == 200 and all(r.extra == f"extra{r.id}" and r.text == [f"t{r.id}"] for r in got)
    odd = spark.createDataFrame([(1, None), (2, [None]), (3, [])], "id int, attempts array<string>")
    assert [r.entities for r in annotators.answers_to_entities(odd).collect()] == [[], [], []]


def test_model_is_asked_again_only_for_failures():
    calls = []

    def ask(prompts):
        calls.append(prompts)
        return ["no" if p.endswith("bad") or (p.endswith("late") and len(calls) < 3) else ANSWER % p for p in prompts]

    model = annotators.LanguageModel("find {TEXT}", ask)
    assert [len(e) for e in model.annotate(["a", "late", "bad", None])] == [1, 1, 0, 1]
    assert calls == [["find a", "find late", "find bad", "find "], ["find late", "find bad"], ["find late", "find bad"]]
    several = annotators.LanguageModel("{TEXT}", lambda ps: [[ANSWER % "x", ANSWER % "y"] if p == "ok" else [ANSWER % "x", "no"] for p in ps], attempts=2, choices=2)
    assert [[len(c) for c in t] for t in several.annotate_choices(["ok", "bad"])] == [[1, 1], [0, 0]]


def test_model_gate_and_language_hook(spark):
    assert annotators.allowed_model("big-model-1", "other; big") and annotators.allowed_model("any", None)
    with pytest.raises(ValueError):
        annotators.allowed_model("small", "other; big")
    df = spark.createDataFrame([("abc",), (None,), ("boom",)], "text string")
    assert [r.detected for r in annotators.with_language(df, lambda t: {"abc": "en"}[t]).collect()] == ["en", None, None]


def test_relations_skip_small_chunks(spark):
    class Pairs:
        def predict(self, tokens, entities):
            return [[{"head_pos": [0, 1], "tail_pos": [1, 2], "head_text": t[0], "tail_text": t[1], "label": "l", "score": 1.0}] for t in tokens]

    df = spark.createDataFrame([(i, ["a", "b"], [{"label": "x"}] * (i % 3)) for i in range(9)], "id int, tokens array<string>, entities array<struct<label:string>>")
    got = {r.id: len(r.relations) for r in annotators.predict_relations(df, Pairs(), ["id"], batch=2).collect()}
    assert got == {i: int(i % 3 == 2) for i in range(9)}


def test_resumable(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.createDataFrame([(1,), (2,)], "a int").write.json(src)
    run = lambda: resumable(spark, src, "a int", lambda df: df.withColumn("b", F.col("a") * 2), out, mark).awaitTermination()
    run()
    run()
    assert sorted(r.b for r in spark.read.json(out).collect()) == [2, 4]
    spark.createDataFrame([(5,)], "a int").write.mode("append").json(src)
    run()
    assert sorted(r.b for r in spark.read.json(out).collect()) == [2, 4, 10]


def test_windowed_counts(spark):
    df = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' event_type, 1.5D value union all select timestamp'2024-01-01 00:50:00', 'a', 2D union all select timestamp'2024-01-01 01:00:00', 'a', 3D")
    assert sorted((r.n, r.total) for r in windowed_counts(df).collect()) == [(1, 3.0), (2, 3.5)]


def test_catalog_is_complete():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70


def test_flagship_counts(spark):
    from corpusloom.plans import catalog

    got = {r.label: (r.gold, r.pred, r.correct) for r in catalog.queries()["eval_by_label"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {"Event": (6027, 3563, 3563), "Organization": (6295, 5160, 5160), "Person": (8997, 7337, 7337), "Place": (2002, 1556, 1556), "Time": (0, 1305, 0)}


def test_tasks_grow_with_the_input(monkeypatch, spark, tmp_path):
    from corpusloom import shared
    from corpusloom.operators import evaluate as ev

    path, links = str(tmp_path / "entities"), str(tmp_path / "links")
    rows = [(m, r, 0, f"t{r % 7}", "L") for r in range(400) for m in "abz"] + [("a", 1, 0, None, "L")]
    spark.createDataFrame(rows, "model string, rec long, chunk int, text string, label string").write.parquet(path)
    spark.createDataFrame([(r, 0, f"t{r % 7}", r / 400) for r in range(0, 400, 2)], "rec long, chunk int, text string, confidence double").write.parquet(links)
    found, linked = spark.read.parquet(path), spark.read.parquet(links)
    gold = found.filter("model = 'a'").drop("model", "chunk")
    read = lambda: (sorted(linking.linkability(found, linked, ["a", "b"]).collect()), sorted(ev.cells(gold, found.drop("chunk"), ["a", "b"], ()).collect()))
    few = read()
    assert shared.dealt_by(found, "rec").rdd.getNumPartitions() == 4
    monkeypatch.setattr(shared, "SHARE", 500)
    size = sum(f.stat().st_size for f in (tmp_path / "entities").glob("*.parquet"))
    assert shared.dealt_by(found, "rec").rdd.getNumPartitions() == -(-size // 500) > 4
    assert read() == few and few[0][0].aligned_chunks == 200
    counts = {(r.model, r.bucket): (r.gold, r.pred, r.correct) for r in few[1] if r.bucket}
    assert counts["z", "1-3"] == (0, 400, 0) and counts["b", "1-3"] == (400, 400, 400)
    plan = ev.cells(gold, found.drop("chunk"), ["a", "b"], ())._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(rec#" in plan and "REPARTITION_BY_NUM" in plan


def test_links_are_placed_in_one_join(spark):
    docs = spark.createDataFrame([("d", ["abc", "xbc"])], "id string, text array<string>")
    links = spark.createDataFrame([("d", "xb"), ("d", "zz")], "doc_id string, entity_text string")
    placed, lost = linking.with_first_chunk(docs, links)
    assert "Join" not in placed.unionByName(lost)._jdf.queryExecution().optimizedPlan().toString()
    assert [r.chunk_idx for r in placed.collect()] == [1] and [r.chunk_idx for r in lost.collect()] == [None]
