import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import chunking, entities as en, text as tx
from corpusloom.operators import align, relations as rel, sampling


def one(spark, column, *values, ddl=None):
    schema = ddl or ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([tuple(values)], schema).select(column.alias("v")).first().v


E1 = {"start": 0, "end": 2, "label": "Person", "text": "Al", "confidence": 0.9}


@pytest.mark.parametrize(
    "text,n",
    [
        (json.dumps([E1]), 1),
        ("```json" + json.dumps([E1, E1]) + "```", 2),
        ("<think>x</think>" + json.dumps([E1]), 1),
        (str([E1]), 1),
        (json.dumps([E1 | {"confidence": 1.2}]), None),
        (json.dumps([E1 | {"start": "5"}]), 1),
        (json.dumps([{k: v for k, v in E1.items() if k != "end"}]), None),
        (json.dumps([E1 | {"more": 1}]), 1),
        ("garbage", None),
        ("[]", 0),
        (json.dumps([E1]) + " trailing", None),
        (json.dumps(E1), None),
        (None, None),
    ],
)
def test_responses(spark, text, n):
    got = one(spark, en.validated(en.parsed(en.clean_response(F.col("c0")))), text)
    assert (None if got is None else len(got)) == n
    if got:
        assert got[0].asDict().keys() == E1.keys()


def test_first_valid_attempt(spark):
    good, bad = json.dumps([E1]), "no"
    assert len(one(spark, en.first_valid(F.array("c0", "c1")), bad, good)) == 1
    assert one(spark, en.first_valid(F.array("c0", "c0", "c0", "c1")), bad, good) == []


A, B = [{"text": "a"}], [{"text": "b"}, {"text": "b2"}]


@pytest.mark.parametrize(
    "ents,chunk,choice,n",
    [
        (None, 0, 0, 0),
        ([[7, A], [1, B]], 0, 0, 1),
        ([A, B], 1, 0, 2),
        ([[], B], 0, 0, 0),
        ([5, [0, B]], 0, 0, 2),
        ([[1, 2, {"text": "x"}]], 0, 0, 1),
        ([5], 0, 0, 0),
        ({"chunk_0": A}, 0, 3, 1),
        ({"chunk_0": [A, B]}, 0, 1, 2),
        ({"chunk_0": [5, B]}, 0, 0, 2),
        ({"chunk_0": []}, 0, 0, 0),
        ({"choice_1": [A, B]}, 1, 1, 2),
        ({"choice_10": [A], "choice_2": [B]}, 0, 0, 2),
        ({"choice_2": [B]}, 3, 0, 0),
        ({"other": 1}, 0, 0, 0),
        ("text", 0, 0, 0),
    ],
)
def test_polymorphic_entities(spark, ents, chunk, choice, n):
    raw = None if ents is None else json.dumps(ents)
    assert one(spark, F.size(en.chunk_entities(F.col("c0"), F.lit(chunk), F.lit(choice))), raw) == n


def test_normalised(spark):
    raw = json.dumps(
        [
            {"start": 1, "end": 99, "label": " P ", "text": " x ", "score": 0.5},
            {"start_char": "0", "end_char": 2, "label": "Q", "text": "y", "confidence": 0.1},
            {"start": None, "start_char": 0, "end": 2, "label": "Q"},
            {"start": -1, "end": 2, "label": "Q"},
            {"start": 3, "end": 3, "label": "Q"},
            {"start": 20, "end": 30, "label": "Q"},
            {"start": 0, "end": 2, "label": " "},
        ]
    )
    items = F.try_variant_get(F.try_parse_json("c0"), "$", "array<variant>")
    got = one(spark, en.normalised(items, F.lit("0123456789")), raw)
    assert [tuple(e) for e in got] == [(1, 10, "P", "x", 0.5), (0, 2, "Q", "y", 0.1)]


def test_labels(spark):
    assert one(spark, F.transform(F.array("c0", "c1", "c2"), lambda x: en.canonical_label(x)), " publication_TITLE ", "point  of_interest", "Big_Thing") == ["Publication", "Point of Interest", "Big Thing"]
    pairs = "array<struct<text:string,label:string>>"
    df = spark.createDataFrame([([("a", "ArtWork"), ("b", "Artist"), ("c", "Dataset")],)], f"p {pairs}")
    got = df.select(en.remapped(F.col("p"), en.label_map("fine"), en.SCORED).alias("s"), en.remapped(F.col("p"), en.label_map("fine", "clean"), en.SCORED).alias("c"), en.remapped(F.col("p"), None, en.SCORED).alias("n")).first()
    assert [[tuple(e) for e in x] for x in got] == [[("b", "Person")], [("a", "Creative Work"), ("b", "Person")], [("c", "Dataset")]]


WORDS = list("abcdef")
TAGS = ["B-X", "I-X", "O", "I-X", "I-Y", "B-Y"]


def test_iob2(spark):
    df = spark.createDataFrame([(WORDS, TAGS, [1, 2, 0, 2, 4, 3])], "w array<string>, t array<string>, n array<bigint>")
    named = df.select(en.iob2_entities(F.col("w"), F.col("t")).alias("e")).first().e
    assert [tuple(e) for e in named] == [("a b", "X"), ("d", "X"), ("e", "Y"), ("f", "Y")]
    numbered = df.select(en.iob2_numbered_entities(F.col("w"), F.col("n"), {"O": 0, "B-X": 1, "I-X": 2, "B-Y": 3, "I-Y": 4}).alias("e")).first().e
    assert [tuple(e) for e in numbered] == [("a b d", "X"), ("e", "Y"), ("f", "Y")]
    rows = spark.createDataFrame([(1, WORDS, TAGS), (2, None, None), (3, [], [])], "k int, words array<string>, tags array<string>")
    assert [tuple(r) for r in en.iob2_rows(rows, ["k"]).orderBy("start").collect()] == [(1, 0, "a b", "X"), (1, 3, "d", "X"), (1, 4, "e", "Y"), (1, 5, "f", "Y")]
    assert [r.text for r in en.iob2_rows(rows, ["k"], passing_over=True).orderBy("start").collect()] == ["a b d", "e", "f"]


def test_prompt(spark):
    assert one(spark, en.filled_prompt("find {A} in {B}", {"A": F.lit("x"), "B": F.col("c0")}), "t") == "find x in t"
    with pytest.raises(Exception, match="unfilled"):
        one(spark, en.filled_prompt("find {A} in {B}", {"A": F.col("c0")}), "t")


def test_text_functions(spark):
    assert one(spark, tx.fix_hyphenation(F.col("c0")), "é-\né a-\n b") == "éé a-\n b"
    assert one(spark, tx.collapse_whitespace(F.col("c0")), "a  \t b \n\n c") == "a b\n c"
    assert one(spark, tx.lines(F.col("c0")), "a\r\nb c\n") == ["a", "b c"] and one(spark, tx.lines(F.col("c0")), "") == []
    lines = ["ab", "fine line here", "@@@ ###", "nice ☃ sky", "xbcdfghx", ""]
    assert [one(spark, tx.is_gibberish(F.col("c0")), x) for x in lines] == [True, False, True, True, True, True]
    assert one(spark, tx.clean_page(F.col("c0")), "A good long line\nxx\nbcdfghj kl\nother line\n") == "A good long line\nother line"
    assert one(spark, tx.redirect_domain(F.col("c0"), {"a.b": "c.d"}), "http://a.b/x/y?z") == "http://c.d/x/y?z"
    assert one(spark, tx.redirect_domain(F.col("c0"), {"a.b": "c.d"}), "nope") == "nope" and one(spark, tx.url_domain(F.col("c0")), "nope") == ""
    assert one(spark, tx.tokens_to_surface(F.array("c0", "c1", "c2", "c3")), "(", "a", ")", ",") == "(a),"
    toks = one(spark, tx.token_offsets(F.col("c0")), "Zoë's co-op, x")
    assert [tuple(t) for t in toks] == [("Zoë", 0, 3), ("'", 3, 4), ("s", 4, 5), ("co-op", 6, 11), (",", 11, 12), ("x", 13, 14)]
    rows = tx.token_rows(spark.createDataFrame([(1, "Zoë's co-op, x"), (2, None), (3, " ")], "k int, t string"), ["k"], "t").orderBy("idx").collect()
    assert [(r.token, r.start, r.end) for r in rows] == [tuple(t) for t in toks]


def test_chunks(spark):
    text = "word " * 250
    pieces = one(spark, chunking.chunks(F.col("c0")), text)
    assert all(20 <= len(p) <= 512 for p in pieces) and " ".join(pieces).split() == text.split()
    assert [len(p) for p in one(spark, chunking.chunks(F.col("c0")), "x" * 600)] == [512, 88]
    lapped = one(spark, chunking.with_overlap(chunking.chunks(F.col("c0"))), text)
    assert lapped[1] == pieces[0][-50:] + pieces[1] and lapped[0] == pieces[0]
    assert one(spark, chunking.chunks(F.col("c0")), "short") == []


def test_alignment():
    text = "The Universty of Oxford, in England"
    at = lambda s, e, t, label="O": {"start": s, "end": e, "text": t, "label": label, "confidence": None}
    given = [at(4, 23, "University of Oxford"), at(100, 110, "England"), at(100, 110, "zzzz"), at(4, 23, "Universty of Oxford"), at(28, 35, "", "P"), at(0, 3, "Oxfort")]
    got = align.aligned(text, given)
    assert [(e["start_token"], e["end_token"], e["alignment_method"]) for e in got] == [(1, 3, "char_offset"), (6, 6, "text_fuzzy"), (6, 6, "char_offset"), (3, 3, "text_fuzzy")]
    assert all(0 <= e["start_token"] <= e["end_token"] < 7 and 0 <= e["alignment_score"] <= 1 for e in got)
    assert align.similarity("", "a") == 0.0 and align.similarity("A-b", "ab") == 1.0
    assert align.aligned("", [at(0, 1, "x")]) == []


def test_tokenizers_plug_in(spark):
    align.register_tokenizer("letters", lambda text: [(i, i + 1) for i in range(len(text))])
    df = spark.createDataFrame([(1, "ab c", [(1, 3), (1, 3), (9, 10)]), (2, None, None)], "id int, text string, spans array<struct<start:int,end:int>>")
    got = [tuple(r) for r in align.spans_on_tokens(df, ["id"], mode="letters").collect()]
    assert got == [(1, 1, 3, 1, 2), (1, 9, 10, None, None)]
    with pytest.raises(ValueError):
        align.tokenizer("none")


def test_relation_labels_and_rule_errors():
    assert rel.relation_labels(None)[0] == list(rel.RULES) and rel.relation_labels([" b ", "a", "b", ""], {"a": 1}) == (["b", "a"], ["b"])
    with pytest.raises(ValueError, match="'x' allowed_head.*'x' allowed_tail.*' ' allowed_tail"):
        rel.validated_rules({"x": {"allowed_head": "p"}, " ": {"allowed_head": ["p"], "allowed_tail": ["p"]}})


def test_lookup_equals_trying_all_runs():
    import random
    import re
    from difflib import SequenceMatcher

    rng = random.Random(5)
    for _ in range(200):
        text = " ".join("".join(rng.choice("abc,") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 12)))
        tokens, near = align.Tokens(text, align.tokenizer("regex")), rng.choice([None, 0, 3])
        target = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 8)))
        k, n, best = len(re.findall(r"\w+", target)), len(tokens.words), None
        for size in range(max(1, k - 2), k + 5) if k else range(1, 7):
            for i in range(n - size + 1):
                run = align.matchable(tokens.surface(i, i + size - 1))
                if run and align.matchable(target):
                    ratio = SequenceMatcher(None, align.matchable(target), run).ratio()
                    score = ratio + (0 if near is None else 0.05 * (1.0 - min(abs(i - near) / n, 1.0)))
                    if best is None or score > best[0]:
                        best = (score, i, i + size - 1, ratio)
        got = tokens.lookup(target, near)
        assert (got and (got.first, got.last, got.score)) == (best and best[1:])


def test_relation_rules(spark):
    with pytest.raises(ValueError):
        rel.validated_rules({"r": {"allowed_head": []}})
    assert rel.validated_rules({" r ": {"allowed_head": ["publication_title", "Publication"], "allowed_tail": ["x_y"]}}) == {"r": {"allowed_head": ["Publication"], "allowed_tail": ["x y"]}}
    ents = spark.createDataFrame([(1, 0, 1, "Event", "Big Day", "Big Day"), (1, 3, 3, "Time", "noon", "noon")], "c int, start_token int, end_token int, label string, text string, text_tokenized string")
    rows = [
        (1, [0, 2], [3, 4], "Big Day", "noon", "occurred during"),
        (1, [9, 10], [3, 4], "big  DAY", "noon", "occurred during"),
        (1, [3, 4], [0, 2], "noon", "Big Day", "occurred during"),
        (1, [3, 4], [0, 2], "noon", "Big Day", "no rule"),
        (1, [3], [0, 2], "noon", "Big Day", "no rule"),
    ]
    df = spark.createDataFrame(rows, "c int, head_pos array<int>, tail_pos array<int>, head_text string, tail_text string, label string")
    assert sorted((r.head_pos[0], r.label) for r in rel.constrained(df, ents, ["c"]).collect()) == [(0, "occurred during"), (3, "no rule"), (9, "occurred during")]


def test_quotas():
    assert sampling.balanced_quotas({"a": 100, "b": 3, "c": 50}, 30) == {"a": 14, "b": 3, "c": 13}
    assert sum(sampling.balanced_quotas({"a": 5, "b": 5}, 9).values()) == 9
    with pytest.raises(ValueError):
        sampling.balanced_quotas({"a": 1}, 2)


def test_lines_are_cut_without_folds_and_aligned_once(spark, tmp_path):
    from corpusloom.plans import annotations, flows

    text = "Some words of Rome x\nand Paris. " + "Abcd efg " * 30
    spark.createDataFrame([(1, text, "en", "s", 0), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    lines = annotations.lines_with_entities(spark, str(tmp_path))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan(lines)
    rows = {r.line: r for r in lines.collect()}
    assert [tuple(e) for e in rows[0].entities] == [(9, 13, "Event", "omee", 0.9), (23, 27, "Event", "Rome", 0.9)] and len(rows[1].entities) == 31
    report = flows.relation_report(spark, str(tmp_path))
    assert plan(report).count("MapInArrow") == 2 and report.first().total_chunks == 2  # one for lines, one for their alignment


def test_regex_tokens_by_arrays_equal_the_pattern():
    import random

    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("ab-_ .é'\nς\x1c" + "文" * (rng.random() < 0.01)) for _ in range(rng.randint(0, 40)))
        assert [tuple(s) for s in align.Tokens(text, align.tokenizer("regex")).spans.tolist()] == align.by_pattern(r"\w+(?:[-_]\w+)*|\S")(text)
    assert all(len(align.matchable(chr(c))) == (kind == 1) for c, kind in enumerate(align.KINDS))
    tokens = align.Tokens("ΑΣ ' Β xyz " * 3, align.tokenizer("regex"))
    assert tokens.run(0, 2) == align.matchable(tokens.surface(0, 2)) and tokens.lookup("xyz", 0, 0.7).score == 1.0
    assert tokens.lookup("qqq", 0, 0.7) is None


@pytest.mark.parametrize("passing_over", [False, True])
def test_iob2_hands_on_bounded_batches(monkeypatch, spark, passing_over):
    import pyarrow as pa

    taken = {}

    class Fake:
        schema = spark.createDataFrame([], "k int").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, kinds):
            taken["run"] = run

    monkeypatch.setattr(en, "FULL", 10)
    en.iob2_rows(Fake(), ["k"], passing_over=passing_over)
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([["a", "b", "c", "d"]] * 9), pa.array([["B-X"] * 4] * 9)], names=["k", "words", "tags"])
    out = list(taken["run"](iter([batch])))
    assert [b.num_rows for b in out] == [12, 12, 12] and [x for b in out for x in b.column(0).to_pylist()] == [k for k in range(9) for _ in range(4)]


def test_spans_hand_on_bounded_batches(monkeypatch):
    import pyarrow as pa

    taken = {}

    class Fake:
        schema = {}

        def select(self, *_):
            return self

        def mapInArrow(self, run, kinds):
            taken["run"] = run

    monkeypatch.setattr(align, "FULL", 3)
    align.spans_on_tokens(Fake(), [])
    spans = pa.array([[{"start": 0, "end": 1}, {"start": 1, "end": 2}], None, [{"start": 0, "end": 4}, {"start": 0, "end": 4}]] * 4)
    batch = pa.RecordBatch.from_arrays([pa.array(["ab c", "x", "ab c"] * 4), spans], names=["text", "spans"])
    got = list(taken["run"](iter([batch])))
    want = [(0, 1, 0, 0), (1, 2, 0, 0), (0, 4, 0, 1)] * 4
    assert [b.num_rows for b in got] == [5, 4, 3] and [tuple(r.values()) for b in got for r in b.to_pylist()] == want
