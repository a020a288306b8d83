"""Evaluation of annotators: multiset matching, precision/recall/F1 roll-ups, confusions, agreement, scenarios."""

from __future__ import annotations

import math
from functools import cache, reduce
from itertools import combinations_with_replacement

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from corpusloom.shared import dealt_by, stash

LENGTH_BUCKETS = ((3, "1-3"), (7, "4-7"), (15, "8-15"), (30, "16-30"))
HISTOGRAM = 4096


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top.cast("double") / bottom).otherwise(F.lit(0.0))


def with_prf(df: DataFrame, gold: str = "gold", pred: str = "pred", correct: str = "correct") -> DataFrame:
    """Adds `precision, recall, f1` of three counts; 0 where a denominator is."""
    g, p, c = F.col(gold), F.col(pred), F.col(correct)
    return df.withColumns({"precision": ratio(c, p), "recall": ratio(c, g), "f1": ratio(2 * c.cast("double"), g + p)})


def length_bucket(text: Column) -> Column:
    n = F.length(text)
    out = reduce(lambda acc, b: acc.when(n <= b[0], b[1]), LENGTH_BUCKETS[1:], F.when(n <= LENGTH_BUCKETS[0][0], LENGTH_BUCKETS[0][1]))
    return out.otherwise("31+")


def cells(gold: DataFrame, pred: DataFrame, models: list[str], dims: tuple[str, ...] = ("dataset", "lang")) -> DataFrame:
    """Counts `gold, pred, correct` by model, `dims`, label and length bucket.

    An entity matches as often as the lesser of its counts on both sides, by record, surface
    and label.  Both sides are added up in one grouping (no join) with a count for gold and
    one for each model; only its rows are spread over the models, each held against all gold
    rows.  Rows are dealt out by record to a number of tasks that grows with the input.
    Models that aren't named have no gold and keep their rows.
    """
    per = ["rec", *dims, "text", "label"]
    known = list(dict.fromkeys(models))
    kind = pred.schema["model"].dataType
    other = ~F.coalesce(F.col("model").isin(known), F.lit(False))
    left = gold.select(*per, F.lit(-1).alias("m"), F.lit(None).cast(kind).alias("other"))
    at = reduce(lambda acc, i: acc.when(F.col("model") == known[i], i), range(1, len(known)), F.when(F.col("model") == known[0], 0))
    right = pred.select(*per, F.coalesce(at, F.lit(-2)).alias("m"), F.when(other, F.col("model")).alias("other"))
    rows = dealt_by(left.unionByName(right), "rec")
    n = lambda i: F.count(F.when(F.col("m") == i, 1))
    counted = rows.groupBy(*per, "other").agg(n(-1).alias("g"), n(-2).alias("q"), *[n(i).alias(f"p{i}") for i in range(len(known))])
    own = [F.struct(F.lit(m).cast(kind).alias("model"), F.col("g").alias("g"), F.col(f"p{i}").alias("p")) for i, m in enumerate(known)]
    own = [F.when(F.col("other").isNull() & (s["g"] + s["p"] > 0), s) for s in own]
    strange = F.when(F.col("q") > 0, F.struct(F.col("other").alias("model"), F.lit(0).cast("long").alias("g"), F.col("q").alias("p")))
    matched = counted.select(*per, F.inline(F.array_compact(F.array(*own, strange))))
    return (
        matched.withColumn("bucket", length_bucket(F.col("text")))
        .groupBy("model", *dims, "label", "bucket")
        .agg(F.sum("g").alias("gold"), F.sum("p").alias("pred"), F.sum(F.least("g", "p")).alias("correct"))
    )


def sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("gold", "pred", "correct")]


def roll_up(table: DataFrame, *dims: str) -> DataFrame:
    """Counts and scores by `dims`."""
    return with_prf(table.groupBy(*dims).agg(*sums()))


ROLL_UPS = (("model",), ("model", "dataset"), ("model", "label"), ("model", "dataset", "label"), ("model", "bucket"), ("model", "lang"), ("model", "lang", "label"))


def all_roll_ups(table: DataFrame) -> DataFrame:
    """The seven roll-ups in one pass by grouping sets; `level` names the columns grouped by."""
    dims = ["model", "dataset", "label", "bucket", "lang"]
    sets = [[F.col(c) for c in s] for s in ROLL_UPS]
    level = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in dims])
    return with_prf(table.groupingSets(sets, *dims).agg(*sums(), level.alias("level")))


def macro_f1(table: DataFrame, *dims: str) -> DataFrame:
    """Unweighted mean of the labels' F1, over every label seen in gold or predictions."""
    return roll_up(table, *dims, "label").groupBy(*dims).agg(F.avg("f1").alias("macro_f1"))


def summary(table: DataFrame, *dims: str) -> DataFrame:
    """Counts, micro scores and `macro_f1` by `dims`, from one grouping by label."""
    by_label = roll_up(table, *dims, "label")
    return with_prf(by_label.groupBy(*dims).agg(*sums(), F.avg("f1").alias("macro_f1")))


def label_variance(table: DataFrame) -> DataFrame:
    by_label = roll_up(table, "model", "label")
    out = by_label.groupBy("model").agg(F.count(F.lit(1)).alias("labels"), F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"))
    return out.withColumn("cv_f1", F.when(F.col("mean_f1") > 0, F.col("std_f1") / F.col("mean_f1")).otherwise(F.lit(0.0)))


def confusions(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """`model, gold_label, pred_label, count`: predictions that differ from a surface's main gold label.

    The main label is the most frequent one of the record and surface, of equals the first seen.
    """
    seen = gold.groupBy("rec", "text", "label").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    main = seen.groupBy("rec", "text").agg(F.max_by("label", F.struct("n", (-F.col("first")).alias("f"))).alias("gold_label"))
    counts = pred.groupBy("model", "rec", "text", F.col("label").alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))
    differ = counts.join(main, ["rec", "text"]).filter("pred_label <> gold_label")
    return differ.groupBy("model", "gold_label", "pred_label").agg(F.sum("n").alias("count"))


def top_labels(table: DataFrame, k: int, measure: str = "gold", label: str = "label") -> DataFrame:
    """The k labels with the most of `measure`, ties by name."""
    return table.groupBy(label).agg(F.sum(measure).alias(measure)).orderBy(F.col(measure).desc(), label).limit(k)


def pivoted(df: DataFrame, rows: list[str], column: str, values: list[str], measure: str, how=F.sum) -> DataFrame:
    """Wide table with the given columns in the given order, 0 where there is nothing."""
    return df.groupBy(*rows).pivot(column, values).agg(how(measure)).na.fill(0, subset=values)


def unpivot_models(wide: DataFrame, keys: list[str], prefix: str = "preds_") -> DataFrame:
    """Wide records with a column for each model -> one row per model; the model is the name less the prefix."""
    models = [c for c in wide.columns if c.startswith(prefix)]
    long = wide.unpivot(keys, models, "_column", "preds")
    return long.select(*keys, F.substring("_column", len(prefix) + 1, 1000).alias("model"), "preds").filter("preds is not null")


def entity_pairs(raw: Column) -> Column:
    """Entities given as [text, label] or as objects -> array of {text, label} as strings.

    Objects may name the surface `text`, `entity` or `mention`, empty values fall through;
    entries without text or label are dropped.  `raw` is JSON text.
    """
    items = F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")

    def pair(e: Column) -> Column:
        at = lambda path: F.try_variant_get(e, path, "string")
        named = F.coalesce(*[F.nullif(at(f"$.{k}"), F.lit("")) for k in ("text", "entity", "mention")])
        return F.struct(F.coalesce(at("$[0]"), named).alias("text"), F.coalesce(at("$[1]"), at("$.label")).alias("label"))

    return F.coalesce(F.filter(F.transform(items, pair), lambda e: e["text"].isNotNull() & e["label"].isNotNull()), F.array().cast("array<struct<text:string,label:string>>"))


def run_masks(rows: DataFrame, runs: list) -> DataFrame:
    """`rec, run, text, label` -> `rec, mask` for each distinct entity of a record: bit i is set if run i has it.

    Dealt by record once; both this grouping and one by record are local after that.
    """
    known = F.create_map(*[x for i, r in enumerate(runs) for x in (F.lit(r), F.lit(1 << i).cast("long"))])
    bit = F.try_element_at(known, F.col("run"))
    marked = rows.select("rec", "text", "label", bit.alias("bit")).filter("bit is not null")
    return marked.repartition("rec").groupBy("rec", "text", "label").agg(F.bit_or("bit").alias("mask"))


def pairwise_agreement(rows: DataFrame, spine: DataFrame, runs: list) -> DataFrame:
    """Mean Jaccard, entity F1 and share of exact matches over the records of `spine`, for each pair of runs, a run with itself too.

    An entity is a record's (text, label).  Each record's entities become one bit mask of
    runs, so all pairs come from one grouping; at most 63 runs.  Two empty sets agree fully,
    also in records where no run found anything.
    """
    pairs = list(combinations_with_replacement(range(len(runs)), 2))
    has = lambda *bits: F.sum((F.col("mask").bitwiseAND(sum(1 << b for b in set(bits))) == sum(1 << b for b in set(bits))).cast("long"))
    counts = run_masks(rows, runs).groupBy("rec").agg(*[has(a, b).alias(f"n{a}_{b}") for a, b in pairs])
    every = spine.select(F.col("rec").alias("_rec")).join(counts, F.col("_rec") == F.col("rec"), "left")
    n = lambda a, b: F.coalesce(F.col(f"n{a}_{b}"), F.lit(0)).cast("double")
    means = []
    for a, b in pairs:
        shared, one, two = n(a, b), n(a, a), n(b, b)
        empty = one + two == 0
        means += [
            F.avg(F.when(empty, 1.0).otherwise(shared / (one + two - shared))).alias(f"j{a}_{b}"),
            F.avg(F.when(empty, 1.0).otherwise(2 * shared / (one + two))).alias(f"f{a}_{b}"),
            F.avg(((shared == one) & (shared == two)).cast("double")).alias(f"e{a}_{b}"),
        ]
    wide = every.agg(F.count(F.lit(1)).alias("n"), *means).filter("n > 0")
    found = [
        F.struct(
            F.lit(runs[a]).alias("run_a"), F.lit(runs[b]).alias("run_b"), F.col("n").alias("n_common_chunks"),
            F.col(f"j{a}_{b}").alias("jaccard"), F.col(f"f{a}_{b}").alias("entity_f1"), F.col(f"e{a}_{b}").alias("exact_match_rate"),
        )
        for a, b in pairs
    ]
    return wide.select(F.inline(F.array(*found)))


def agreement_matrix(pairs: DataFrame, runs: list, measure: str) -> DataFrame:
    """Symmetric matrix of a measure of `pairwise_agreement`: `run` and a column `run_<r>` for each run."""
    both = pairs.select(F.col("run_a").alias("run"), F.col("run_b").alias("other"), measure)
    both = both.union(pairs.filter("run_a <> run_b").select("run_b", "run_a", measure))
    return both.groupBy("run").pivot("other", runs).agg(F.first(measure)).withColumnsRenamed({str(r): f"run_{r}" for r in runs})


def consensus(rows: DataFrame, spine: DataFrame, runs: list) -> DataFrame:
    """Share of the records of `spine` for which all runs found the same entities."""
    same = run_masks(rows, runs).groupBy("rec").agg(F.min((F.col("mask") == (1 << len(runs)) - 1).cast("int")).alias("same"))
    every = spine.select(F.col("rec").alias("_rec")).join(same, F.col("_rec") == F.col("rec"), "left")
    return every.agg(F.count(F.lit(1)).alias("n_common_chunks"), F.avg(F.coalesce("same", F.lit(1)).cast("double")).alias("consensus_rate"))


@cache
def student_t(freedom: int, share: float = 0.95) -> float:
    """Value that the absolute of Student's t stays below with probability `share`, to 6 places.

    The probability is a finite sum over powers of the cosine of atan(t / sqrt(n)); it is
    inverted by bisection.  Beyond 2000 degrees of freedom the normal quantile with its first
    two corrections is exact to that many places.
    """
    if freedom > 2000:
        z = 1.959963984540054 if share == 0.95 else student_t(2000, share)
        return round(z + (z**3 + z) / (4 * freedom) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * freedom**2), 6)

    def inside(t: float) -> float:
        angle = math.atan(t / math.sqrt(freedom))
        cos, sin = math.cos(angle), math.sin(angle)
        odd = freedom % 2
        term, total = (cos, cos) if odd else (1.0, 1.0)
        for k in range(3 if odd else 2, freedom - 1, 2):
            term *= cos * cos * (k - 1) / k
            total += term
        return 2 / math.pi * (angle + (sin * total if freedom > 1 else 0)) if odd else sin * total

    low, high = 0.0, 1.0
    while inside(high) < share:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if inside(middle) < share else (low, middle)
    return round(low, 6)


@pandas_udf(T.DoubleType())
def _t_of_runs(n: pd.Series) -> pd.Series:
    return n.map(lambda k: student_t(int(k) - 1) if k > 1 else None).astype("float64")


def run_interval(per_run: DataFrame, metrics: list[str], dims: list[str] | None = None) -> DataFrame:
    """`dims, metric, mean, ci95_low, ci95_high, plus_minus, n_runs` by Student's t over any number of runs; no interval for one."""
    dims = dims or []
    long = per_run.unpivot(["run", *dims], metrics, "metric", "value")
    out = long.groupBy(*dims, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("s"), F.count(F.lit(1)).alias("n_runs"))
    pm = _t_of_runs("n_runs") * F.col("s") / F.sqrt(F.col("n_runs").cast("double"))
    out = out.withColumn("plus_minus", pm)
    return out.select(*dims, "metric", "mean", (F.col("mean") - F.col("plus_minus")).alias("ci95_low"), (F.col("mean") + F.col("plus_minus")).alias("ci95_high"), "plus_minus", "n_runs")


def mean_confusions(per_run: DataFrame, n_runs: int) -> DataFrame:
    """Confusions `run, gold_label, pred_label, count` averaged over all runs; a run without one counts as 0."""
    return per_run.groupBy("gold_label", "pred_label").agg((F.sum("count").cast("double") / n_runs).alias("count"))


def mean_over_runs(per_run: DataFrame, dims: list[str], measures: list[str]) -> DataFrame:
    """Metrics of a model of several runs: the mean of the runs' metrics, counts too."""
    return per_run.groupBy(*dims).agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in measures], F.count(F.lit(1)).alias("n_runs"))


def exact_percentile(rows: DataFrame, by: list[str], value: str, share: float, name: str) -> DataFrame:
    """`by, name`: each group's percentile of `value`, interpolated, without gathering a group's values.

    Distinct values are counted and written once.  A histogram of HISTOGRAM buckets between a
    group's least and greatest value tells which bucket (two, if the rank falls between) holds
    the rank; only the values of that bucket are put in order.  Nulls don't take part.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = stash(counts, "percentile")
    same = [f"_{c}" for c in by]
    spread = counts.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.sum("_n").alias("_all"))
    matching = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(s)) for c, s in zip(by, same, strict=True)])
    room = F.col("_most") - F.col("_least")
    bucket = F.when(room > 0, F.floor((F.col("_v") - F.col("_least")) / room * HISTOGRAM)).otherwise(F.lit(0)).cast("int")
    placed = counts.join(spread, matching).withColumn("_bucket", bucket)
    histogram = placed.groupBy(*same, "_bucket").agg(F.sum("_n").alias("_in"), F.first("_all").alias("_all"))
    place = (F.col("_all") - 1) * F.lit(float(share))
    upto = F.sum("_in").over(Window.partitionBy(*same).orderBy("_bucket"))
    marked = histogram.withColumn("_before", upto - F.col("_in")).filter((F.col("_before") <= F.ceil(place)) & (F.col("_before") + F.col("_in") > F.floor(place)))
    marked = marked.select(*[F.col(c).alias(f"_{c}") for c in same], F.col("_bucket").alias("_b"), "_before")
    inside = placed.join(marked, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]) & (F.col("_bucket") == F.col("_b")))
    ranked = inside.withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_bucket").orderBy("_v")))
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    ends = ranked.groupBy(*by).agg(at(F.floor(place)).alias("_low"), at(F.ceil(place)).alias("_high"), F.first("_all").alias("_all"))
    between = (F.ceil(place) - place) * F.col("_low") + (place - F.floor(place)) * F.col("_high")
    return ends.select(*by, F.when(F.floor(place) == F.ceil(place), F.col("_low")).otherwise(between).alias(name))


def label_thresholds(rows: DataFrame, share: float = 0.4) -> DataFrame:
    """`label, threshold`: the confidence that the top `share` of a label's entities reach, interpolated."""
    return exact_percentile(rows, ["label"], "conf", 1 - share, "threshold")


def above_label_threshold(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Entities at or above their label's threshold."""
    limits = thresholds.select(F.col("label").alias("_label"), F.col("threshold").alias("_limit"))
    return rows.join(limits, (F.col("label") == F.col("_label")) & (F.col("conf") >= F.col("_limit")), "left_semi")


def above(rows: DataFrame, limit: float) -> DataFrame:
    return rows.filter(F.col("conf") >= limit)


def coverage(gold: DataFrame, pred: DataFrame, key: list[str]) -> DataFrame:
    """Chunks with gold, with predictions, with both, and the share of gold chunks that align, for each model."""
    g = gold.select(*key).distinct()
    p = pred.select("model", *key).distinct()
    tagged = g.crossJoin(F.broadcast(p.select("model").distinct())).select("model", *key, F.lit(1).alias("g"), F.lit(0).alias("p"))
    both = tagged.unionByName(p.select("model", *key, F.lit(0).alias("g"), F.lit(1).alias("p"))).groupBy("model", *key).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    g, p = F.col("g") == 1, F.col("p") == 1
    out = both.groupBy("model").agg(
        count(g).alias("gold_chunks_available"), count(p).alias("pred_chunks_available"), count(g & p).alias("aligned_chunks_used"), count(p & ~g).alias("pred_only_chunks"), count(g & ~p).alias("gold_missing_for_model")
    )
    return out.withColumn("aligned_ratio_vs_gold", ratio(F.col("aligned_chunks_used"), F.col("gold_chunks_available")))


def poisson_steps(bits: int = 40) -> list[float]:
    """Cumulative probabilities of a Poisson(1) variable, as far as `bits` bits can tell them from 1."""
    steps, term, total = [], math.exp(-1), 0.0
    while 1 - total > 2.0**-bits:
        total += term
        term /= len(steps) + 1
        steps.append(total)
    return steps


def bootstrap_interval(counts: DataFrame, iterations: int = 200, seed: int = 42) -> DataFrame:
    """Percentile interval of micro F1 when records are drawn anew.

    `counts` has `rec, gold, pred, correct`.  Each record enters each replicate as often as a
    Poisson(1) variable says that 40 bits of the MD5 of seed, record and replicate determine:
    one pass, no resampling on the driver, equal results on every run and in any engine.
    """
    drawn = counts.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rec").cast("string"), F.col("replicate").cast("string")).cast("binary"))
    u = F.conv(F.substring(digest, 1, 10), 16, 10).cast("long").cast("double") / (1 << 40)
    times = reduce(lambda a, b: a + b, [(F.col("_u") >= s).cast("int") for s in poisson_steps()])
    summed = drawn.withColumn("_u", u).withColumn("w", times).groupBy("replicate").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("gold", "pred", "correct")])
    return with_prf(summed).agg(F.avg("f1").alias("mean"), F.percentile("f1", 0.025).alias("ci95_low"), F.percentile("f1", 0.975).alias("ci95_high"), F.count(F.lit(1)).alias("n_bootstrap"))


def error_rate(relations: DataFrame) -> DataFrame:
    """Share of relations judged invalid, with counts of missing and non-binary verdicts (`valid` is a number or null)."""
    v = F.col("valid")
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    out = relations.agg(
        F.countDistinct("item").alias("items_with_relations"), F.count(F.lit(1)).alias("relations"), count(v == 1).alias("valid_relations"), count(v == 0).alias("invalid_relations"),
        count(v.isNull()).alias("missing_flags"), count(v.isNotNull() & ~v.isin(0, 1)).alias("non_binary_flags"),
    )
    return out.withColumn("error_rate", ratio(F.col("invalid_relations"), F.col("valid_relations") + F.col("invalid_relations")))
