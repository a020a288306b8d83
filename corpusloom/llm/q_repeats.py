"""Queries op3 and op9: repeats removed from all documents."""

from pyspark.sql import functions as F

from corpusloom.llm.automaton_dedup import automaton_dedup
from corpusloom.llm.suffix_dedup import suffix_dedup


def op3_suffix_dedup(spark, sf_dir):
    done = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_automaton_dedup(spark, sf_dir):
    done = automaton_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup, "op9_automaton_dedup": op9_automaton_dedup}

ORACLE_SQL: dict[str, str] = {}
