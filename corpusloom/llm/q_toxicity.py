"""Query op1: severity of all documents."""

from pyspark.sql import functions as F

from corpusloom.llm.toxicity import severity

REJECT = 0.35


def op1_toxicity_ordinal(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    graded = severity(read("documents"), read("labels"))
    return graded.select("doc_id", F.col("severity").alias("expected_severity"), F.col("grade").cast("int").alias("grade"), (F.col("severity") >= REJECT).alias("toxic"))


QUERIES = {"op1_toxicity_ordinal": op1_toxicity_ordinal}
