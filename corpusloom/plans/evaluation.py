"""Evaluation queries over synthetic annotators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import evaluate as ev
from corpusloom.plans.adapters import SQL_CELLS, SQL_MENTIONS, SQL_SUMS, annotated, mentions, runs, spine, sql_prf

MODELS = ("a", "b", "c")


def cell_table(spark, sf_dir, models=MODELS):
    gold, pred = annotated(spark, sf_dir, models)
    return ev.cells(gold, pred, list(models))


def rolled(*dims, models=MODELS):
    return lambda spark, sf_dir: ev.roll_up(cell_table(spark, sf_dir, models), *dims)


def summed(*dims):
    return lambda spark, sf_dir: ev.summary(cell_table(spark, sf_dir), *dims)


def eval_by_label(spark, sf_dir):
    return ev.roll_up(cell_table(spark, sf_dir, ("a",)), "label")


def eval_grouping_sets(spark, sf_dir):
    return ev.all_roll_ups(cell_table(spark, sf_dir))


def eval_macro_f1(spark, sf_dir):
    return ev.macro_f1(cell_table(spark, sf_dir), "model", "dataset")


def eval_label_variance(spark, sf_dir):
    return ev.label_variance(cell_table(spark, sf_dir))


def confusion_table(spark, sf_dir):
    return ev.confusions(*annotated(spark, sf_dir))


def eval_confusion_pivot(spark, sf_dir):
    wide = ev.pivoted(confusion_table(spark, sf_dir), ["model", "gold_label"], "pred_label", ["Event", "Organization", "Person", "Place", "Time"], "count")
    return wide.select("model", "gold_label", *[F.col(c).cast("long").alias(c.lower()) for c in ("Event", "Organization", "Person", "Place", "Time")])


def eval_f1_pivot(spark, sf_dir):
    by = ev.roll_up(cell_table(spark, sf_dir), "model", "dataset")
    wide = ev.pivoted(by, ["dataset"], "model", list(MODELS), "f1", F.first)
    return wide.select("dataset", *[F.col(m).alias(f"f1_{m}") for m in MODELS])


def eval_top_labels(spark, sf_dir):
    return ev.top_labels(cell_table(spark, sf_dir, ("a",)), 3)


def eval_top_confused(spark, sf_dir):
    return ev.top_labels(confusion_table(spark, sf_dir), 10, "count", "gold_label")


def eval_unpivot_models(spark, sf_dir):
    _, pred = annotated(spark, sf_dir, ("a", "b"))
    wide = pred.groupBy("rec").pivot("model", ["a", "b"]).agg(F.count(F.lit(1))).withColumnsRenamed({"a": "preds_a", "b": "preds_b"})
    return ev.unpivot_models(wide, ["rec"])


RUNS = [1, 2, 3, 4, 5]


def runs_pairwise_agreement(spark, sf_dir):
    return ev.pairwise_agreement(runs(spark, sf_dir), spine(spark, sf_dir), RUNS)


def runs_agreement_matrix(spark, sf_dir):
    return ev.agreement_matrix(runs_pairwise_agreement(spark, sf_dir), RUNS, "jaccard")


def runs_consensus(spark, sf_dir):
    return ev.consensus(runs(spark, sf_dir), spine(spark, sf_dir), RUNS)


def run_scores(spark, sf_dir, *dims):
    gold, _ = annotated(spark, sf_dir, ("a",))
    rows = runs(spark, sf_dir).withColumn("model", F.col("run")).withColumn("dataset", F.lit(""))
    table = ev.cells(gold.withColumn("dataset", F.lit("")), rows, RUNS).withColumnRenamed("model", "run")
    return ev.summary(table, "run", *dims)


def runs_mean_ci(spark, sf_dir):
    return ev.run_interval(run_scores(spark, sf_dir), ["precision", "recall", "f1", "macro_f1"])


def run_scores_by_label(spark, sf_dir):
    gold, _ = annotated(spark, sf_dir, ("a",))
    rows = runs(spark, sf_dir).withColumn("model", F.col("run"))
    return ev.roll_up(ev.cells(gold, rows, RUNS, ("lang",)), "model", "label").withColumnRenamed("model", "run")


def runs_label_means(spark, sf_dir):
    return ev.mean_over_runs(run_scores_by_label(spark, sf_dir), ["label"], ["gold", "pred", "correct", "precision", "recall", "f1"])


def runs_label_ci(spark, sf_dir):
    return ev.run_interval(run_scores_by_label(spark, sf_dir), ["precision", "recall", "f1"], ["label"])


def runs_mean_confusions(spark, sf_dir):
    """Confusions of five runs, which mistake surfaces of 6 to 5 + run letters for places."""
    gold, _ = annotated(spark, sf_dir, ("a",))
    n = F.length("text")
    rows = runs(spark, sf_dir).withColumn("label", F.when(n.between(6, 5 + F.col("run")), "Place").otherwise(F.col("label")))
    return ev.mean_confusions(ev.confusions(gold, rows.withColumn("model", F.col("run"))).withColumnRenamed("model", "run"), len(RUNS))


def scenario_pred_threshold(spark, sf_dir):
    gold, pred = annotated(spark, sf_dir)
    return ev.summary(ev.cells(gold, ev.above(pred, 0.85), list(MODELS)), "model")


def label_thresholds_top40(spark, sf_dir):
    return ev.label_thresholds(annotated(spark, sf_dir)[0])


def scenario_gold_threshold(spark, sf_dir):
    gold, pred = annotated(spark, sf_dir)
    return ev.summary(ev.cells(ev.above_label_threshold(gold, ev.label_thresholds(gold)), pred, list(MODELS)), "model")


def coverage(spark, sf_dir):
    gold, pred = annotated(spark, sf_dir)
    return ev.coverage(gold.filter((F.col("rec") + F.col("ord")) % 3 != 0), pred.filter("conf > 0.9"), ["rec"])


def eval_bootstrap_ci(spark, sf_dir):
    gold, pred = annotated(spark, sf_dir, ("a",))
    per = [F.sum(c).alias(c) for c in ("gold", "pred", "correct")]
    g = gold.groupBy("rec", "text", "label").agg(F.count(F.lit(1)).alias("g"), F.lit(0).alias("p"))
    p = pred.groupBy("rec", "text", "label").agg(F.lit(0).alias("g"), F.count(F.lit(1)).alias("p"))
    matched = g.unionByName(p).groupBy("rec", "text", "label").agg(F.sum("g").alias("gold"), F.sum("p").alias("pred")).withColumn("correct", F.least("gold", "pred"))
    return ev.bootstrap_interval(matched.groupBy("rec").agg(*per))


QUERIES = {
    "eval_by_label": eval_by_label,
    "eval_summary": summed("model"),
    "eval_by_source": summed("model", "dataset"),
    "eval_by_lang": rolled("model", "lang"),
    "eval_by_length_bucket": rolled("model", "bucket"),
    "eval_by_source_label": rolled("model", "dataset", "label"),
    "eval_by_lang_label": rolled("model", "lang", "label"),
    "eval_grouping_sets": eval_grouping_sets,
    "eval_macro_f1": eval_macro_f1,
    "eval_label_variance": eval_label_variance,
    "eval_confusions": confusion_table,
    "eval_confusion_pivot": eval_confusion_pivot,
    "eval_f1_pivot": eval_f1_pivot,
    "eval_top_labels": eval_top_labels,
    "eval_top_confused": eval_top_confused,
    "eval_unpivot_models": eval_unpivot_models,
    "eval_bootstrap_ci": eval_bootstrap_ci,
    "runs_pairwise_agreement": runs_pairwise_agreement,
    "runs_agreement_matrix": runs_agreement_matrix,
    "runs_consensus": runs_consensus,
    "runs_label_ci": runs_label_ci,
    "runs_mean_confusions": runs_mean_confusions,
    "runs_mean_ci": runs_mean_ci,
    "runs_label_means": runs_label_means,
    "scenario_pred_threshold": scenario_pred_threshold,
    "scenario_gold_threshold": scenario_gold_threshold,
    "label_thresholds_top40": label_thresholds_top40,
    "coverage": coverage,
}


def sql_roll(*dims: str, where: str = "TRUE") -> str:
    d = ", ".join(dims)
    return f"WITH {SQL_CELLS}, s AS (SELECT {d}, {SQL_SUMS} FROM cells WHERE {where} GROUP BY {d}) SELECT *, {sql_prf()} FROM s"


def sql_summary(*dims: str, cells: str = SQL_CELLS, name: str = "cells") -> str:
    d = ", ".join(dims)
    return f"""WITH {cells}, bl0 AS (SELECT {d}, label, {SQL_SUMS} FROM {name} GROUP BY {d}, label), bl AS (SELECT *, {sql_prf()} FROM bl0),
s AS (SELECT {d}, {SQL_SUMS}, avg(f1) AS macro_f1 FROM bl GROUP BY {d}) SELECT *, {sql_prf()} FROM s"""


SQL_CONFUSIONS = SQL_MENTIONS + """,
seen AS (SELECT doc_id, txt, gold, count(*) AS n, min(i) AS first FROM fa GROUP BY ALL),
main AS (SELECT doc_id, txt, gold AS gold_label FROM seen QUALIFY row_number() OVER (PARTITION BY doc_id, txt ORDER BY n DESC, first) = 1),
pc2 AS (SELECT model, doc_id, txt, label AS pred_label, count(*) AS n FROM pred GROUP BY ALL),
conf AS (SELECT model, gold_label, pred_label, CAST(sum(n) AS BIGINT) AS count FROM pc2 JOIN main USING (doc_id, txt) WHERE pred_label <> gold_label GROUP BY ALL)"""

SQL_RUNS = SQL_MENTIONS + """,
r AS (SELECT unnest([1, 2, 3, 4, 5]) AS run),
rr AS (SELECT run, doc_id, lang, i, txt, gold AS label FROM fa CROSS JOIN r WHERE CASE WHEN run < 5 THEN (doc_id + i) % (20 + run) <> 0 ELSE (doc_id + i) % 3 <> 0 END),
sets AS (SELECT d.doc_id, r.run, coalesce(list_sort(list(DISTINCT rr.txt || '|' || rr.label) FILTER (WHERE rr.txt IS NOT NULL)), []) AS ents
         FROM documents d CROSS JOIN r LEFT JOIN rr ON d.doc_id = rr.doc_id AND r.run = rr.run GROUP BY d.doc_id, r.run)"""

SQL_RUN_CELLS = SQL_RUNS + """,
rg AS (SELECT run, doc_id, txt, gold AS label, count(*) AS g FROM fa CROSS JOIN r GROUP BY ALL),
rp AS (SELECT run, doc_id, txt, label, count(*) AS p FROM rr GROUP BY ALL),
rc AS (SELECT coalesce(rg.run, rp.run) AS run, coalesce(rg.label, rp.label) AS label, CAST(sum(coalesce(g, 0)) AS BIGINT) AS gold, CAST(sum(coalesce(p, 0)) AS BIGINT) AS pred,
         CAST(sum(least(coalesce(g, 0), coalesce(p, 0))) AS BIGINT) AS correct
       FROM rg FULL JOIN rp ON rg.run = rp.run AND rg.doc_id = rp.doc_id AND rg.txt = rp.txt AND rg.label = rp.label GROUP BY ALL)"""


SQL_AGREEMENT = f"""WITH {SQL_RUNS}, pr AS (
SELECT a.run AS run_a, b.run AS run_b, len(list_intersect(a.ents, b.ents)) AS s, len(a.ents) AS na, len(b.ents) AS nb
FROM sets a JOIN sets b ON a.doc_id = b.doc_id AND a.run <= b.run)
SELECT run_a, run_b, count(*) AS n_common_chunks, avg(CASE WHEN na + nb = 0 THEN 1.0::DOUBLE ELSE CAST(s AS DOUBLE) / (na + nb - s) END) AS jaccard,
  avg(CASE WHEN na + nb = 0 THEN 1.0::DOUBLE ELSE 2 * CAST(s AS DOUBLE) / (na + nb) END) AS entity_f1, avg(CASE WHEN s = na AND s = nb THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS exact_match_rate
FROM pr GROUP BY ALL"""


def sql_cells_of(gold: str, pred: str) -> str:
    """Cells where gold and predictions are filtered first."""
    return SQL_CELLS.replace("FROM fa CROSS JOIN models", f"FROM ({gold}) fa CROSS JOIN models").replace("FROM pred GROUP BY ALL", f"FROM ({pred}) pred GROUP BY ALL")


ORACLE_SQL = {
    "eval_by_label": sql_roll("label", where="model = 'a'"),
    "eval_summary": sql_summary("model"),
    "eval_by_source": sql_summary("model", "dataset"),
    "eval_by_lang": sql_roll("model", "lang"),
    "eval_by_length_bucket": sql_roll("model", "bucket"),
    "eval_by_source_label": sql_roll("model", "dataset", "label"),
    "eval_by_lang_label": sql_roll("model", "lang", "label"),
    "eval_grouping_sets": f"""WITH {SQL_CELLS}, s AS (
SELECT model, dataset, label, bucket, lang, {SQL_SUMS},
  concat_ws('+', CASE WHEN grouping(model) = 0 THEN 'model' END, CASE WHEN grouping(dataset) = 0 THEN 'dataset' END, CASE WHEN grouping(label) = 0 THEN 'label' END,
            CASE WHEN grouping(bucket) = 0 THEN 'bucket' END, CASE WHEN grouping(lang) = 0 THEN 'lang' END) AS level
FROM cells GROUP BY GROUPING SETS ((model), (model, dataset), (model, label), (model, dataset, label), (model, bucket), (model, lang), (model, lang, label)))
SELECT *, {sql_prf()} FROM s""",
    "eval_macro_f1": f"""WITH {SQL_CELLS}, s AS (SELECT model, dataset, label, {SQL_SUMS} FROM cells GROUP BY ALL), f AS (SELECT *, {sql_prf()} FROM s)
SELECT model, dataset, avg(f1) AS macro_f1 FROM f GROUP BY ALL""",
    "eval_label_variance": f"""WITH {SQL_CELLS}, s AS (SELECT model, label, {SQL_SUMS} FROM cells GROUP BY ALL), f AS (SELECT *, {sql_prf()} FROM s),
v AS (SELECT model, count(*) AS labels, avg(f1) AS mean_f1, stddev_pop(f1) AS std_f1 FROM f GROUP BY model)
SELECT *, CASE WHEN mean_f1 > 0 THEN std_f1 / mean_f1 ELSE 0.0::DOUBLE END AS cv_f1 FROM v""",
    "eval_confusions": f"WITH {SQL_CONFUSIONS} SELECT * FROM conf",
    "eval_confusion_pivot": f"""WITH {SQL_CONFUSIONS} SELECT model, gold_label, """
    + ", ".join(f"CAST(coalesce(sum(count) FILTER (WHERE pred_label = '{c}'), 0) AS BIGINT) AS {c.lower()}" for c in ("Event", "Organization", "Person", "Place", "Time"))
    + " FROM conf GROUP BY ALL",
    "eval_f1_pivot": f"""WITH {SQL_CELLS}, s AS (SELECT model, dataset, {SQL_SUMS} FROM cells GROUP BY ALL), f AS (SELECT *, {sql_prf()} FROM s) SELECT dataset, """
    + ", ".join(f"coalesce(max(f1) FILTER (WHERE model = '{m}'), 0.0::DOUBLE) AS f1_{m}" for m in MODELS)
    + " FROM f GROUP BY dataset",
    "eval_top_labels": f"WITH {SQL_CELLS} SELECT label, CAST(sum(gold) AS BIGINT) AS gold FROM cells WHERE model = 'a' GROUP BY label ORDER BY gold DESC, label LIMIT 3",
    "eval_top_confused": f"WITH {SQL_CONFUSIONS} SELECT gold_label, CAST(sum(count) AS BIGINT) AS count FROM conf GROUP BY gold_label ORDER BY count DESC, gold_label LIMIT 10",
    "eval_unpivot_models": f"WITH {SQL_MENTIONS} SELECT doc_id AS rec, model, count(*) AS preds FROM pred WHERE model IN ('a', 'b') GROUP BY ALL",
    "runs_pairwise_agreement": SQL_AGREEMENT,
    "runs_agreement_matrix": f"""WITH b AS (SELECT run_a AS run, run_b AS other, jaccard FROM ({SQL_AGREEMENT}) UNION SELECT run_b, run_a, jaccard FROM ({SQL_AGREEMENT}))
SELECT run, """
    + ", ".join(f"max(jaccard) FILTER (WHERE other = {r}) AS run_{r}" for r in RUNS)
    + " FROM b GROUP BY run",
    "runs_consensus": f"""WITH {SQL_RUNS}, k AS (SELECT doc_id, count(DISTINCT ents) AS kinds, count(*) AS n FROM sets GROUP BY doc_id)
SELECT count(*) AS n_common_chunks, avg(CASE WHEN kinds = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS consensus_rate FROM k WHERE n = 5""",
    "runs_mean_ci": f"""WITH {SQL_RUN_CELLS}, bl AS (SELECT *, {sql_prf()} FROM rc),
s AS (SELECT run, {SQL_SUMS}, avg(f1) AS macro_f1 FROM bl GROUP BY run), f AS (SELECT *, {sql_prf()} FROM s),
u AS (UNPIVOT (SELECT run, precision, recall, f1, macro_f1 FROM f) ON precision, recall, f1, macro_f1 INTO NAME metric VALUE value),
m AS (SELECT metric, avg(value) AS mean, stddev_samp(value) AS s, count(*) AS n_runs FROM u GROUP BY metric)
SELECT metric, mean, mean - 2.776445::DOUBLE * s / sqrt(n_runs) AS ci95_low, mean + 2.776445::DOUBLE * s / sqrt(n_runs) AS ci95_high, 2.776445::DOUBLE * s / sqrt(n_runs) AS plus_minus, n_runs FROM m""",
    "runs_label_ci": f"""WITH {SQL_RUN_CELLS}, bl AS (SELECT *, {sql_prf()} FROM rc),
u AS (UNPIVOT (SELECT run, label, precision, recall, f1 FROM bl) ON precision, recall, f1 INTO NAME metric VALUE value),
m AS (SELECT label, metric, avg(value) AS mean, stddev_samp(value) AS s, count(*) AS n_runs FROM u GROUP BY label, metric)
SELECT label, metric, mean, mean - 2.776445::DOUBLE * s / sqrt(n_runs) AS ci95_low, mean + 2.776445::DOUBLE * s / sqrt(n_runs) AS ci95_high, 2.776445::DOUBLE * s / sqrt(n_runs) AS plus_minus, n_runs FROM m""",
    "runs_mean_confusions": f"""WITH {SQL_RUNS}, seen AS (SELECT doc_id, txt, gold, count(*) AS n, min(i) AS first FROM fa GROUP BY ALL),
main AS (SELECT doc_id, txt, gold AS gold_label FROM seen QUALIFY row_number() OVER (PARTITION BY doc_id, txt ORDER BY n DESC, first) = 1),
p AS (SELECT run, doc_id, txt, CASE WHEN length(txt) BETWEEN 6 AND 5 + run THEN 'Place' ELSE label END AS pred_label FROM rr)
SELECT gold_label, pred_label, CAST(count(*) AS DOUBLE) / 5 AS count FROM p JOIN main USING (doc_id, txt) WHERE pred_label <> gold_label GROUP BY ALL""",
    "runs_label_means": f"""WITH {SQL_RUN_CELLS}, bl AS (SELECT *, {sql_prf()} FROM rc)
SELECT label, """
    + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS {c}" for c in ("gold", "pred", "correct", "precision", "recall", "f1"))
    + ", count(*) AS n_runs FROM bl GROUP BY label",
    "eval_bootstrap_ci": f"""WITH {SQL_CELLS}, pr AS (SELECT coalesce(g.doc_id, p.doc_id) AS rec, coalesce(g, 0) AS g, coalesce(p, 0) AS p
      FROM (SELECT * FROM g WHERE model = 'a') g FULL JOIN (SELECT * FROM p WHERE model = 'a') p ON g.doc_id = p.doc_id AND g.txt = p.txt AND g.label = p.label),
r AS (SELECT rec, CAST(sum(g) AS BIGINT) AS gold, CAST(sum(p) AS BIGINT) AS pred, CAST(sum(least(g, p)) AS BIGINT) AS correct FROM pr GROUP BY rec),
d AS (SELECT r.*, k, CAST('0x' || substr(md5(concat_ws('|', 42, rec, k)), 1, 10) AS BIGINT)::DOUBLE / 1099511627776 AS u FROM r, range(1, 201) t(k)),
w AS (SELECT *, len(list_filter({ev.poisson_steps()}::DOUBLE[], lambda s: u >= s)) AS w FROM d),
s AS (SELECT k, sum(gold * w) AS gold, sum(pred * w) AS pred, sum(correct * w) AS correct FROM w GROUP BY k), f AS (SELECT *, {sql_prf()} FROM s)
SELECT avg(f1) AS mean, quantile_cont(f1, 0.025) AS ci95_low, quantile_cont(f1, 0.975) AS ci95_high, count(*) AS n_bootstrap FROM f""",
    "scenario_pred_threshold": sql_summary("model", cells=sql_cells_of("SELECT * FROM fa", "SELECT * FROM pred WHERE conf >= 0.85")),
    "scenario_gold_threshold": sql_summary(
        "model", cells=sql_cells_of("SELECT f.* FROM fa f JOIN (SELECT gold AS l, quantile_cont(conf, 0.6) AS t FROM fa GROUP BY gold) q ON f.gold = q.l AND f.conf >= q.t", "SELECT * FROM pred")
    ),
    "label_thresholds_top40": f"WITH {SQL_MENTIONS} SELECT gold AS label, quantile_cont(conf, 0.6) AS threshold FROM fa GROUP BY gold",
    "coverage": f"""WITH {SQL_MENTIONS},
g AS (SELECT DISTINCT doc_id FROM fa WHERE (doc_id + i) % 3 <> 0), p AS (SELECT DISTINCT model, doc_id FROM pred WHERE conf > 0.9),
gm AS (SELECT model, doc_id FROM g CROSS JOIN (SELECT DISTINCT model FROM p)),
b AS (SELECT coalesce(gm.model, p.model) AS model, gm.doc_id IS NOT NULL AS hg, p.doc_id IS NOT NULL AS hp FROM gm FULL JOIN p ON gm.model = p.model AND gm.doc_id = p.doc_id)
SELECT model, count(*) FILTER (WHERE hg) AS gold_chunks_available, count(*) FILTER (WHERE hp) AS pred_chunks_available, count(*) FILTER (WHERE hg AND hp) AS aligned_chunks_used,
  count(*) FILTER (WHERE hp AND NOT hg) AS pred_only_chunks, count(*) FILTER (WHERE hg AND NOT hp) AS gold_missing_for_model,
  CASE WHEN count(*) FILTER (WHERE hg) > 0 THEN CAST(count(*) FILTER (WHERE hg AND hp) AS DOUBLE) / count(*) FILTER (WHERE hg) ELSE 0.0::DOUBLE END AS aligned_ratio_vs_gold
FROM b GROUP BY model""",
}
