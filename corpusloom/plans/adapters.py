"""Deterministic stand-ins for annotations, derived from the test tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MENTION = r"[A-Z][a-z]{2,}"
LABELS = ("Person", "Place", "Organization", "Event")


#: Session setting: into how many tasks scans of texts are dealt out.  Unset, scans stay as Spark cuts them, which
#: `spark.sql.files.maxPartitionBytes` steers; a file of a single row group can't be cut, so a benchmark on one such file sets this.
SCAN_TASKS = "spark.corpusloom.scanTasks"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, by default exactly as Spark scans it; see SCAN_TASKS, which changes no result."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = spark.conf.get(SCAN_TASKS, None)
    return df.repartition(int(tasks)) if tasks and name == "documents" else df


def label_of(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LABELS)), (n % 4 + 1).cast("int"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc_id, lang, source, i, txt, n, gold, conf`: every capitalised word of every document."""
    found = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.regexp_extract_all("text", F.lit(MENTION), 0)).alias("i", "txt"))
    n = F.length("txt")
    conf = F.lit(0.5) + ((F.col("doc_id") * 7 + F.col("i") * 13 + n) % 50).cast("double") / 100
    return found.select("*", n.alias("n"), label_of(n).alias("gold"), conf.alias("conf"))


def predicted(model: str) -> tuple[Column, Column]:
    """Whether a synthetic model finds a mention, and the label it gives."""
    d, i, n = F.col("doc_id"), F.col("i"), F.col("n")
    if model == "a":
        return (d + n) % 5 != 0, F.when(n == 7, F.lit("Time")).otherwise(F.col("gold"))
    if model == "b":
        return (d * 3 + i) % 4 != 0, F.when(n == 6, F.lit("Place")).otherwise(F.col("gold"))
    return F.lit(True), F.when((d + n) % 7 == 0, label_of(n + 1)).otherwise(F.col("gold"))


def annotated(spark: SparkSession, sf_dir: str, models: tuple[str, ...] = ("a", "b", "c")) -> tuple[DataFrame, DataFrame]:
    """Gold and predicted entities: `rec, dataset, lang, ord, text, label` (and `model`, `conf`)."""
    rows = mentions(spark, sf_dir)
    base = [F.col("doc_id").alias("rec"), F.col("source").alias("dataset"), "lang", F.col("i").alias("ord"), F.col("txt").alias("text")]
    gold = rows.select(*base, F.col("gold").alias("label"), "conf")
    given = F.array(*[F.when(keep, F.struct(F.lit(m).alias("model"), label.alias("label"))) for m in models for keep, label in [predicted(m)]])
    pred = rows.select(*base, "conf", F.explode(F.array_compact(given)).alias("_p")).select("_p.model", *[c for c in ("rec", "dataset", "lang", "ord", "text")], "_p.label", "conf")
    return gold, pred


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five runs of one annotator: `run, rec, ord, text, label, lang`; run 5 is an outlier."""
    d, i = F.col("doc_id"), F.col("i")
    kept = F.array(*[F.when(((d + i) % (20 + r) != 0) if r < 5 else ((d + i) % 3 != 0), F.lit(r)) for r in range(1, 6)])
    rows = mentions(spark, sf_dir).select(F.explode(F.array_compact(kept)).alias("run"), F.col("doc_id").alias("rec"), F.col("i").alias("ord"), F.col("txt").alias("text"), F.col("gold").alias("label"), "lang")
    return rows


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records, also those without a mention."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec"), F.col("source").alias("dataset"), "lang")


SQL_MENTIONS = f"""
arr AS (SELECT doc_id, lang, source, regexp_extract_all(text, '{MENTION}') AS m FROM documents),
men AS (SELECT doc_id, lang, source, unnest(m) AS txt, generate_subscripts(m, 1) - 1 AS i FROM arr),
fa AS (SELECT *, length(txt) AS n,
         CASE length(txt) % 4 WHEN 0 THEN 'Person' WHEN 1 THEN 'Place' WHEN 2 THEN 'Organization' ELSE 'Event' END AS gold,
         0.5::DOUBLE + CAST((doc_id * 7 + i * 13 + length(txt)) % 50 AS DOUBLE) / 100 AS conf
       FROM men),
pa AS (SELECT 'a' AS model, doc_id, lang, source, i, txt, n, CASE WHEN n = 7 THEN 'Time' ELSE gold END AS label, conf FROM fa WHERE (doc_id + n) % 5 <> 0),
pb AS (SELECT 'b' AS model, doc_id, lang, source, i, txt, n, CASE WHEN n = 6 THEN 'Place' ELSE gold END AS label, conf FROM fa WHERE (doc_id * 3 + i) % 4 <> 0),
pc AS (SELECT 'c' AS model, doc_id, lang, source, i, txt, n,
         CASE WHEN (doc_id + n) % 7 = 0 THEN CASE (n + 1) % 4 WHEN 0 THEN 'Person' WHEN 1 THEN 'Place' WHEN 2 THEN 'Organization' ELSE 'Event' END ELSE gold END AS label,
         conf FROM fa),
pred AS (SELECT * FROM pa UNION ALL SELECT * FROM pb UNION ALL SELECT * FROM pc),
models AS (SELECT unnest(['a', 'b', 'c']) AS model)"""

SQL_CELLS = SQL_MENTIONS + """,
g AS (SELECT model, doc_id, source, lang, txt, gold AS label, count(*) AS g FROM fa CROSS JOIN models GROUP BY ALL),
p AS (SELECT model, doc_id, source, lang, txt, label, count(*) AS p FROM pred GROUP BY ALL),
j AS (SELECT coalesce(g.model, p.model) AS model, coalesce(g.source, p.source) AS dataset, coalesce(g.lang, p.lang) AS lang, coalesce(g.label, p.label) AS label,
        coalesce(g.txt, p.txt) AS txt, coalesce(g, 0) AS g, coalesce(p, 0) AS p
      FROM g FULL JOIN p ON g.model = p.model AND g.doc_id = p.doc_id AND g.txt = p.txt AND g.label = p.label),
cells AS (SELECT model, dataset, lang, label,
            CASE WHEN length(txt) <= 3 THEN '1-3' WHEN length(txt) <= 7 THEN '4-7' WHEN length(txt) <= 15 THEN '8-15' WHEN length(txt) <= 30 THEN '16-30' ELSE '31+' END AS bucket,
            CAST(sum(g) AS BIGINT) AS gold, CAST(sum(p) AS BIGINT) AS pred, CAST(sum(least(g, p)) AS BIGINT) AS correct
          FROM j GROUP BY ALL)"""


def sql_prf(gold: str = "gold", pred: str = "pred", correct: str = "correct") -> str:
    """Precision, recall and F1 of three counts, 0 where a denominator is."""
    p = f"CASE WHEN {pred} > 0 THEN CAST({correct} AS DOUBLE) / {pred} ELSE 0.0::DOUBLE END"
    r = f"CASE WHEN {gold} > 0 THEN CAST({correct} AS DOUBLE) / {gold} ELSE 0.0::DOUBLE END"
    f = f"CASE WHEN {gold} + {pred} > 0 THEN 2 * CAST({correct} AS DOUBLE) / ({gold} + {pred}) ELSE 0.0::DOUBLE END"
    return f"{p} AS precision, {r} AS recall, {f} AS f1"


SQL_SUMS = "CAST(sum(gold) AS BIGINT) AS gold, CAST(sum(pred) AS BIGINT) AS pred, CAST(sum(correct) AS BIGINT) AS correct"
