import math
import random
from collections import Counter

import pytest

from corpusloom.operators import evaluate as ev

#: Published counts and scores: gold, pred, correct, precision, recall, f1.
PUBLISHED = [
    (281926, 219221, 143801, 0.6559636, 0.5100665, 0.5738875),
    (281926, 404851, 193994, 0.47917, 0.68810, 0.56494),
    (281926, 418373, 192294, 0.45962, 0.68207, 0.54918),
]


def test_published_scores(spark):
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(PUBLISHED)], "i int, gold long, pred long, correct long")
    for r in ev.with_prf(df).collect():
        want = PUBLISHED[r.i]
        assert all(abs(a - b) < 1e-5 for a, b in zip((r.precision, r.recall, r.f1), want[3:]))


def test_zero_denominators(spark):
    r = ev.with_prf(spark.createDataFrame([(0, 0, 0)], "gold long, pred long, correct long")).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def rows(seed, n=300):
    rng = random.Random(seed)
    one = lambda: (rng.randint(0, 8), rng.choice(["x", "y"]), rng.choice(["en", None]), rng.randint(0, 40), rng.choice(["aa", "bbbb", "c" * 40]), rng.choice(["P", "Q", "R"]))
    return [one() for _ in range(n)], [(rng.choice(["m1", "m2"]), *one()) for _ in range(n)]


GOLD, PRED = "rec int, dataset string, lang string, ord int, text string, label string", "model string, rec int, dataset string, lang string, ord int, text string, label string"


def test_cells_match_multisets(spark):
    gold, pred = rows(1)
    cells = ev.cells(spark.createDataFrame(gold, GOLD), spark.createDataFrame(pred, PRED), ["m1", "m2"])
    got = {(r.model, r.label): (r.gold, r.pred, r.correct) for r in ev.roll_up(cells, "model", "label").collect()}
    for m in ("m1", "m2"):
        g = Counter((r, d, lg, t, lb) for r, d, lg, _, t, lb in gold)
        p = Counter((r, d, lg, t, lb) for mm, r, d, lg, _, t, lb in pred if mm == m)
        for label in "PQR":
            pick = lambda c: sum(n for k, n in c.items() if k[-1] == label)
            assert got[m, label] == (pick(g), pick(p), sum(min(n, p[k]) for k, n in g.items() if k[-1] == label))
    levels = ev.all_roll_ups(cells)
    assert {r.level for r in levels.select("level").distinct().collect()} == {"+".join(c for c in ("model", "dataset", "label", "bucket", "lang") if c in s) for s in ev.ROLL_UPS}
    assert all(r.correct <= min(r.gold, r.pred) for r in levels.collect())


def test_macro_counts_labels_seen_only_in_predictions(spark):
    gold = spark.createDataFrame([(1, "d", "en", 0, "a", "P")], GOLD)
    pred = spark.createDataFrame([("m", 1, "d", "en", 0, "a", "P"), ("m", 1, "d", "en", 1, "b", "Q")], PRED)
    cells = ev.cells(gold, pred, ["m"])
    assert ev.macro_f1(cells, "model").first().macro_f1 == 0.5
    v = ev.label_variance(cells).first()
    assert (v.labels, v.mean_f1, v.std_f1, v.cv_f1) == (2, 0.5, 0.5, 1.0)


def test_confusions_take_the_first_of_equals(spark):
    gold = spark.createDataFrame([(1, "d", "en", 0, "a", "P"), (1, "d", "en", 1, "a", "Q"), (1, "d", "en", 2, "b", "R")], GOLD)
    pred = spark.createDataFrame([("m", 1, "d", "en", 0, "a", "Q"), ("m", 1, "d", "en", 0, "a", "Q"), ("m", 1, "d", "en", 0, "b", "R"), ("m", 1, "d", "en", 0, "c", "P")], PRED)
    assert [tuple(r) for r in ev.confusions(gold, pred).collect()] == [("m", "P", "Q", 2)]
    assert ev.confusions(gold, pred.limit(0)).count() == 0


@pytest.mark.parametrize("n,want", [(0, "1-3"), (3, "1-3"), (4, "4-7"), (7, "4-7"), (8, "8-15"), (15, "8-15"), (16, "16-30"), (30, "16-30"), (31, "31+")])
def test_length_buckets(spark, n, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(ev.length_bucket(F.lit("é" * n))).first()[0] == want


def test_agreement(spark):
    rows = spark.createDataFrame([(1, 1, "a", "P"), (1, 1, "b", "P"), (1, 2, "a", "P"), (1, 2, "a", "P"), (2, 1, "c", "P"), (2, 2, "c", "P"), (2, 9, "z", "P")], "rec int, run int, text string, label string")
    spine = spark.createDataFrame([(1,), (2,), (3,)], "rec int")
    got = {(r.run_a, r.run_b): r for r in ev.pairwise_agreement(rows, spine, [1, 2]).collect()}
    assert got[1, 1].jaccard == got[2, 2].entity_f1 == 1.0 and got[1, 2].n_common_chunks == 3
    assert math.isclose(got[1, 2].jaccard, (0.5 + 1 + 1) / 3) and math.isclose(got[1, 2].entity_f1, (2 / 3 + 2) / 3) and math.isclose(got[1, 2].exact_match_rate, 2 / 3)
    m = {r.run: r for r in ev.agreement_matrix(ev.pairwise_agreement(rows, spine, [1, 2]), [1, 2], "jaccard").collect()}
    assert m[1].run_2 == m[2].run_1 == got[1, 2].jaccard and m[1].run_1 == 1.0
    c = ev.consensus(rows, spine, [1, 2]).first()
    assert c.n_common_chunks == 3 and math.isclose(c.consensus_rate, 2 / 3)


def test_student_t():
    # Published quantiles (97.5 %).
    for freedom, want in ((1, 12.706205), (2, 4.302653), (3, 3.182446), (4, 2.776445), (9, 2.262157), (10, 2.228139), (30, 2.042272), (100, 1.983972), (1000, 1.962339)):
        assert math.isclose(ev.student_t(freedom), want, abs_tol=2e-6), freedom
    assert abs(ev.student_t(2001) - ev.student_t(2000)) < 1e-5


def test_exact_percentile(spark):
    rng = random.Random(4)
    values = {"a": [rng.random() for _ in range(999)], "b": [rng.choice([0.5, 0.75]) for _ in range(40)], "c": [3.0], None: [rng.gauss(0, 1e6) for _ in range(50)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("d", None)], "k string, v double")
    for share in (0.0, 0.6, 0.975, 1.0):
        got = {r.k: r.t for r in ev.exact_percentile(df, ["k"], "v", share, "t").collect()}
        for k, vs in values.items():
            at, vs = (len(vs) - 1) * share, sorted(vs)
            low, high = math.floor(at), math.ceil(at)
            assert math.isclose(got[k], vs[low] if low == high else (high - at) * vs[low] + (at - low) * vs[high]), (k, share)
        assert "d" not in got


def test_run_interval(spark):
    values = [0.5, 0.52, 0.51, 0.49, 0.6]
    df = spark.createDataFrame(list(enumerate(values)), "run int, f1 double")
    r = ev.run_interval(df, ["f1"]).first()
    mean = sum(values) / 5
    s = math.sqrt(sum((v - mean) ** 2 for v in values) / 4)
    assert math.isclose(r["plus_minus"], 2.776445 * s / math.sqrt(5)) and math.isclose(r["mean"], mean) and r.n_runs == 5
    many = ev.run_interval(spark.createDataFrame([(i, i % 7 / 7) for i in range(25)], "run int, f1 double"), ["f1"]).first()
    assert many.n_runs == 25 and many["plus_minus"] > 0
    assert ev.run_interval(spark.createDataFrame([(1, 0.5)], "run int, f1 double"), ["f1"]).first()["plus_minus"] is None


def test_bootstrap_is_repeatable_and_centred(spark):
    df = spark.createDataFrame([(i, 10, 10, 7) for i in range(200)], "rec int, gold long, pred long, correct long")
    a, b = ev.bootstrap_interval(df).first(), ev.bootstrap_interval(df.repartition(3)).first()
    assert a == b and math.isclose(a["mean"], 0.7) and a.n_bootstrap == 200


def test_unpivot_and_pairs(spark):
    from pyspark.sql import functions as F

    wide = spark.createDataFrame([(1, "x", None), (2, None, None)], "rec int, preds_a string, preds_b string")
    assert [tuple(r) for r in ev.unpivot_models(wide, ["rec"]).collect()] == [(1, "a", "x")]
    raw = '[["t","L"],{"text":"","entity":"","mention":"m","label":"K"},{"text":"x"},5,["only"]]'
    r = spark.createDataFrame([(raw,), (None,), ("junk",)], "r string").select(ev.entity_pairs(F.col("r")).alias("p")).collect()
    assert [[tuple(p) for p in x.p] for x in r] == [[("t", "L"), ("m", "K")], [], []]


def test_error_rate(spark):
    df = spark.createDataFrame([(i, 0 if i < 35 else 1) for i in range(53)] + [(60, None), (61, 2)], "item int, valid int")
    r = ev.error_rate(df).first()
    assert math.isclose(r.error_rate, 35 / 53) and (r.missing_flags, r.non_binary_flags, r.items_with_relations) == (1, 1, 55)
